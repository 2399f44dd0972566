"""Metric blocks for sharing: stored columns with fallbacks from stored curves, JSON files a detector and data set, and their readers.

Metric tables have a row for each detector and data set, a few thousand at most; curves may be long and are reduced to
one operating point a group before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import finite_or, metric_name, ratio
from ..sources.io import union_all

#: Columns that tie a row of metrics to its curve, as far as both have them.
GROUP_KEYS = ["dataset_name", "dataset_used", "detector_name", "split"]
#: Fixed names of the models behind the known detectors; other detectors stand for themselves.
MODELS = {"gptzero_like": "gptzero_like_logistic_regression", "svm_tfidf": "linear_svm_tfidf", "xgboost_tfidf": "xgboost_tfidf"}
#: The detector whose language model is named beside it.
WITH_LANGUAGE_MODEL = "gptzero_like"
TARGETS = {"metrics_at_1pct_fpr": 0.01, "metrics_at_0.1pct_fpr": 0.001}
PRESENTED_FPR, PRESENTED_TPR = 0.001, 0.8
NOTES = "Exported from an evaluation on the test split."


def model_used(detector: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv]), detector), detector)


def additional_models(detector: Column, language_model: str | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.when(detector == WITH_LANGUAGE_MODEL, F.array(F.lit(language_model))).otherwise(none) if language_model else none


def shared_keys(rows: DataFrame, curve: DataFrame) -> list[str]:
    return [c for c in GROUP_KEYS if c in rows.columns and c in curve.columns]


def _of_group(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on the text of the keys; a missing key is the text ``nan`` on either side."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    named = values.select(*[as_text(c).alias(f"_of_{c}") for c in keys], *[c for c in values.columns if c not in keys])
    on = F.lit(True)
    for c in keys:
        on = on & (as_text(c) == F.col(f"_of_{c}"))
    return rows.join(named, on, "left").drop(*[f"_of_{c}" for c in keys])


def with_curve_points(rows: DataFrame, curve: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Adds for each target ``from_curve_i`` (threshold, actual fpr, and the rates at the point of largest tpr, then largest fpr) and ``curve_fpr_at_tpr``."""
    keys = shared_keys(rows, curve)
    number = lambda c: F.col(c).try_cast("double")
    points = curve.select(*keys, number("fpr").alias("fpr"), number("tpr").alias("tpr"), number("threshold").alias("threshold")).filter("fpr is not null and tpr is not null and not isnan(fpr) and not isnan(tpr)")
    best = [
        F.max_by(F.when(F.col("fpr") <= t, F.struct("threshold", "fpr", "tpr")), F.when(F.col("fpr") <= t, F.struct("tpr", "fpr"))).alias(f"_at{i}")
        for i, t in enumerate([*(targets or TARGETS).values(), PRESENTED_FPR])
    ]
    values = points.groupBy(*keys).agg(*best, F.min(F.when(F.col("tpr") >= PRESENTED_TPR, F.col("fpr"))).alias("curve_fpr_at_tpr"))
    joined = _of_group(rows, values, keys)
    positives, negatives = finite_or(F.col("fn")) + finite_or(F.col("tp")), finite_or(F.col("tn")) + finite_or(F.col("fp"))
    for i in range(len(best)):
        p = F.col(f"_at{i}")
        tp, fp = finite_or(p["tpr"]) * positives, finite_or(p["fpr"]) * negatives
        precision, recall = ratio(tp, tp + fp), finite_or(p["tpr"])
        rates = F.struct(
            finite_or(p["threshold"]).alias("threshold"),
            finite_or(p["fpr"]).alias("actual_fpr"),
            ratio(tp + negatives - fp, positives + negatives).alias("accuracy"),
            precision.alias("precision"),
            recall.alias("recall"),
            ratio(2 * precision * recall, precision + recall).alias("f1"),
        )
        joined = joined.withColumn(f"from_curve_{i}", F.when(p.isNotNull() & (positives > 0) & (negatives >= 0), rates))
    return joined.drop(*[f"_at{i}" for i in range(len(best))])


def _value(df: DataFrame, column: str, fallback: Column) -> Column:
    """The stored number if it is finite, else the curve's, else 0."""
    stored = finite_or(F.col(column), None) if column in df.columns else F.lit(None).cast("double")
    return F.coalesce(stored, finite_or(fallback))


def metric_blocks(rows: DataFrame, curve: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``rows`` of a metrics summary (counts ``tn fp fn tp``, ``roc_auc``, metrics by name and target) with a block for each target and ``presentation_metrics``."""
    targets = targets or TARGETS
    df = with_curve_points(rows, curve, targets)
    auc = finite_or(F.col("roc_auc")) if "roc_auc" in rows.columns else F.lit(0.0)
    for i, (name, t) in enumerate(targets.items()):
        of = lambda m, i=i, t=t: _value(rows, metric_name(m, t), F.col(f"from_curve_{i}")[m])
        recall = of("recall")
        df = df.withColumn(name, F.struct(of("f1").alias("f1"), of("accuracy").alias("accuracy"), of("precision").alias("precision"), recall.alias("recall"), recall.alias("tpr"), auc.alias("auc_roc")))
    n = len(targets)
    shown = F.struct(
        _value(rows, metric_name("tpr", PRESENTED_FPR), F.col(f"from_curve_{n}")["recall"]).alias("tpr_at_0_1pct_fpr"),
        F.coalesce(F.col("curve_fpr_at_tpr"), F.lit(0.0)).alias("fpr_at_80pct_tpr"),
        auc.alias("roc_auc"),
    )
    return df.withColumn("presentation_metrics", shown).drop("curve_fpr_at_tpr", *[f"from_curve_{i}" for i in range(n + 1)])


def share_payloads(rows: DataFrame, curve: DataFrame, existing: DataFrame | None = None, language_model: str | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """``dataset_name, detector_name, payload``: one JSON text for each test row of a summary.

    ``existing(dataset_name, detector_name, payload)`` are files written before: their model, notes and, where none are named
    anew, additional models stay; the metrics are new.
    """
    df = metric_blocks(rows.filter(F.col("split").cast("string") == "test"), curve, targets)
    used, more, notes = model_used(F.col("detector_name")), additional_models(F.col("detector_name"), language_model), F.lit(NOTES)
    if existing is not None:
        df = df.join(existing.select("dataset_name", "detector_name", F.col("payload").alias("_old")), ["dataset_name", "detector_name"], "left")
        old = lambda path: F.get_json_object("_old", path)
        used, notes = F.coalesce(old("$.model_used"), used), F.coalesce(old("$.additional_details.notes"), notes)
        kept = F.coalesce(F.from_json(old("$.additional_details.additional_models_used"), "array<string>"), F.array().cast("array<string>"))
        more = F.when(F.size(more) > 0, more).otherwise(kept)
    payload = F.struct(
        F.concat_ws("_", "dataset_name", "detector_name").alias("experiment_name"),
        F.col("detector_name").alias("detection_method"),
        used.alias("model_used"),
        F.col("dataset_used").alias("dataset_used") if "dataset_used" in rows.columns else F.col("dataset_name").alias("dataset_used"),
        finite_or(F.col("num_samples")).cast("long").alias("num_samples") if "num_samples" in rows.columns else F.lit(0).cast("long").alias("num_samples"),
        F.struct(more.alias("additional_models_used"), notes.alias("notes")).alias("additional_details"),
        *[F.col(f"`{name}`").alias(name) for name in (targets or TARGETS)],
        "presentation_metrics",
    )
    return df.select("dataset_name", "detector_name", F.to_json(payload).alias("payload"))


def write_shared(payloads: DataFrame, folder: str) -> None:
    """A text file of one line under ``dataset_name=…/detector_name=…`` for each payload."""
    payloads.select("dataset_name", "detector_name", F.col("payload").alias("value")).write.mode("overwrite").partitionBy("dataset_name", "detector_name").text(folder)


def read_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.col("dataset_name").cast("string"), F.col("detector_name").cast("string"), F.col("value").alias("payload"))


def rewrite_shared(rows: DataFrame, curve: DataFrame, folder: str, out: str, language_model: str | None = None) -> DataFrame:
    """The payloads of a folder with metrics of a new summary, written to ``out`` (another folder, as Spark reads while it writes)."""
    if folder.rstrip("/") == out.rstrip("/"):
        raise ValueError("a folder cannot be rewritten in place")
    done = share_payloads(rows, curve, read_shared(rows.sparkSession, folder), language_model)
    write_shared(done, out)
    return done


def first_metric(c: Column, metric: str) -> Column:
    """A number of a JSON block by its name; for ``tpr`` the first of tpr, recall and tpr_at_0_1pct_fpr that is there. Text that is no number is null."""
    names = ["tpr", "recall", "tpr_at_0_1pct_fpr"] if metric == "tpr" else [metric]
    return F.coalesce(*[F.get_json_object(c, f"$.{n}") for n in names]).try_cast("double")


def block_metric(payload: Column, metric: str, block: str = "metrics_at_0.1pct_fpr") -> Column:
    """``first_metric`` of a block of a payload; block names may hold dots."""
    return first_metric(F.get_json_object(payload, f"$['{block}']"), metric)


def read_results(spark: SparkSession, pattern: str, side: str | None = None) -> DataFrame:
    """JSON result files (each one object) with ``folder`` and ``file``, and the text ``args`` of the side-car file of the same folder, if ``side`` names one."""
    path = F.col("_metadata.file_path")
    split = lambda df: df.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).drop("path")
    results = split(spark.read.text(pattern, wholetext=True).select(F.col("value").alias("result"), path.alias("path")))
    if side is None:
        return results
    args = split(spark.read.text(side, wholetext=True).select(F.col("value").alias("args"), path.alias("path"))).drop("file")
    return results.join(args, "folder", "left")


def load_metrics(*frames: DataFrame) -> DataFrame:
    """Metric tables of several runs, one below the other, by split and detector."""
    return union_all(*frames).orderBy("split", "detector_name")
