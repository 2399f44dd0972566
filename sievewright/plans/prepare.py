"""From wide question rows to a split, checked data set; the steps of the command line."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_space
from ..operators import exports, features, models, remap
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import reshape as R
from ..operators import rewrite as W
from ..operators import sampling as S
from ..session import stored
from ..sources import io


@dataclass(frozen=True)
class PrepareConfig:
    """``test`` and ``val`` are shares of the groups of rows that share a prompt or a text."""

    dataset: str = "hc3"
    test: float = 0.2
    val: float = 0.1
    seed: int = 42
    most_per_label: int | None = None


def deduplicated(samples: DataFrame) -> DataFrame:
    """The first sample of each normalised text and label; texts are compared by digest."""
    key = F.sha2(normalize_space(F.col("text")), 256)
    return Q.keep_first(samples.withColumn("_t", key), [F.col("_t"), F.col("label")], [F.col("sample_id")]).drop("_t")


def with_splits(samples: DataFrame, config: PrepareConfig) -> DataFrame:
    """Group-disjoint stratified splits: the stratum is a group's most frequent domain and its labels."""
    prompt = normalize_space(F.col("prompt"))
    keyed = samples.withColumn("_p", F.when(prompt == "", F.col("sample_id")).otherwise(F.sha2(prompt, 256))).withColumn("_t", F.sha2(normalize_space(F.col("text")), 256))
    grouped = stored(S.group_components(keyed, "_p", "_t"), "grouped")
    groups = R.group_signature(grouped, "group_id", "domain", "label").withColumn("stratum", F.concat_ws("::", "domain", "labels"))
    split = S.group_splits(stored(groups.select("group_id", "stratum"), "groups"), "group_id", "stratum", config.test, config.val, config.seed)
    return R.ensure_sample_schema(grouped.drop("split").join(split, "group_id"))


def prepare(wide: DataFrame, config: PrepareConfig, row_index: str = "hc3_row_id") -> DataFrame:
    """Samples with ids, capped, de-duplicated, split and checked."""
    samples = R.to_samples(wide, row_index, config.dataset)
    if config.most_per_label:
        samples = S.take_per_group(samples, ["label"], config.most_per_label, "sample_id", config.seed)
    out = stored(with_splits(deduplicated(samples), config), "prepared")
    Q.check_integrity(out, "split", F.sha2(normalize_space(F.col("prompt")), 256), F.sha2(normalize_space(F.col("text")), 256), "label")
    return out


def prepare_command(spark: SparkSession, source: str, out: str, config: PrepareConfig) -> None:
    df = prepare(io.read_wide(spark, source), config)
    io.write_bundle(df, out, {"config": asdict(config), "counts": {f"{r.field}={r.value}": r.n for r in Q.value_counts(df, ["label", "domain"]).collect()}})


def sample_command(spark: SparkSession, source: str, out: str, fraction: float, seed: int) -> None:
    io.write_table(S.sample_fraction(io.read_wide(spark, source), "source", fraction, "hc3_row_id", seed), out)


def shard_command(spark: SparkSession, source: str, out: str, shards: int) -> None:
    df = S.shard(io.read_wide(spark, source), "source", "hc3_row_id", shards)
    df.write.mode("overwrite").partitionBy("shard").parquet(out)


def estimate_command(spark: SparkSession, source: str, out: str, model: str, depths: int, budget: float | None) -> None:
    ai = R.explode_answers(io.read_wide(spark, source), ["source", "question"], "human_answers", "chatgpt_answers").filter("label = 'ai'")
    cost = W.with_cost(W.estimate_usage(ai, [], F.col("question"), F.col("text"), depths), model)
    W.guard_budget(cost, budget)
    io.write_table(cost, out)


def evaluate_command(spark: SparkSession, predictions: str, samples: str, out: str, targets: list[float]) -> None:
    """Summaries per detector and split, per domain too, and curves, from predictions joined with their samples."""
    p = io.read_table(spark, predictions)
    if "decision_threshold" not in p.columns:
        p = p.withColumn("decision_threshold", F.lit(None).cast("double"))
    s = io.read_table(spark, samples, ["sample_id", "label", "domain", "split"])
    joined = p.select("sample_id", "detector_name", "prob_ai", "decision_threshold").join(s, "sample_id", "left")
    if joined.filter("label is null").limit(1).count():
        raise ValueError("predictions without a sample")
    joined = stored(joined.withColumn("y", (F.col("label") == "ai").cast("int")), "joined")
    by = ["detector_name", "split"]
    summary = M.evaluate(joined, by, score="prob_ai").join(M.roc_auc(joined, by, score="prob_ai"), by, "left").join(M.metrics_at_targets(joined, by, targets, score="prob_ai"), by, "left")
    io.write_table(summary, f"{out}/metrics_summary.parquet")
    io.write_table(M.evaluate(joined, [*by, "domain"], score="prob_ai"), f"{out}/metrics_by_domain.parquet")
    io.write_table(M.roc_points(joined, by, score="prob_ai").select(*by, "fpr", "tpr", "threshold"), f"{out}/roc_points.parquet")


def test_set_command(spark: SparkSession, sources: list[str], out: str) -> None:
    """Every table as a test set of its own, named by its file: samples without duplicates, all of split ``test``, and a manifest of the counts."""
    counts = {}
    for path in sources:
        name = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
        wide = io.read_wide(spark, path).withColumn("_number", F.col("hc3_row_id"))
        df = deduplicated(R.to_samples(wide, "_number", name)).withColumn("split", F.lit("test"))
        io.write_table(df, f"{out}/{name}/test.parquet")
        counts[name] = io.count_rows(spark, f"{out}/{name}/test.parquet")
    if not counts:
        raise FileNotFoundError("no test tables")
    io.write_manifest(spark, {"num_samples": counts}, f"{out}/manifest")


def merge_command(spark: SparkSession, pattern: str, out: str) -> None:
    """Wide rows of all shard folders, of equal ids, sources and questions the earliest shard's."""
    rows = io.read_shards(spark, pattern).withColumn("_position", F.col("hc3_row_id"))
    io.write_table(remap.merge_shards(rows, remap.IDENTITY, "shard", "_position").select(*io.WIDE), out)


def export_command(spark: SparkSession, metrics: str, dataset: str, out: str, before: str | None = None) -> None:
    """Shared JSON payloads from the folder that ``evaluate`` wrote, over those of an older export."""
    rows = io.read_table(spark, f"{metrics}/metrics_summary.parquet").withColumn("dataset_name", F.lit(dataset))
    rows = rows.withColumn("num_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    curve = io.read_table(spark, f"{metrics}/roc_points.parquet")
    exports.write_shared(exports.share_payloads(rows, curve, exports.read_shared(spark, before) if before else None), out)


#: Detectors that can be trained and scored, in order.
DETECTORS = ("svm", "trees", "perplexity")


def train_command(spark: SparkSession, samples: str, out: str, detectors: tuple[str, ...] = ("svm",), rounds: int = 120) -> None:
    """Detectors of the samples' train split, saved under their names: the SVM with its curve, calibrated on the val split; the trees, which stop by it; and the perplexity
    detector with its token model and the threshold that is best on it."""
    if unknown := [d for d in detectors if d not in DETECTORS]:
        raise ValueError(f"unknown detectors: {unknown}; known are {DETECTORS}")
    df = io.read_table(spark, samples, ["sample_id", "text", "label", "split"]).withColumn("y", (F.col("label") == "ai").cast("int"))
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    if "svm" in detectors:
        model, curve = models.fit_svm(train, val)
        models.save_model(model, f"{out}/svm")
        models.save_model(curve, f"{out}/curve")
    if "trees" in detectors:
        marked = train.withColumn("validation", F.lit(False)).unionByName(val.withColumn("validation", F.lit(True)))
        models.save_model(models.fit_trees(marked, config=models.TreeConfig(rounds=rounds)), f"{out}/trees")
    if "perplexity" in detectors:
        tokens = features.unigram_model(train, features.word_tokens(features.fold(F.col("text"))))
        tokens.write.mode("overwrite").parquet(f"{out}/perplexity/tokens")
        tokens = spark.read.parquet(f"{out}/perplexity/tokens")
        rows = stored(features.sentence_perplexities(df, "sample_id", "text", tokens).join(df.select("sample_id", "y", "split"), "sample_id"), "features")
        model = models.fit_logistic(rows.filter("split = 'train'"))
        models.save_model(model, f"{out}/perplexity/model")
        io.write_manifest(spark, {"threshold": models.choose_threshold(rows.filter("split = 'val'"), model)}, f"{out}/perplexity/threshold")


def score_command(spark: SparkSession, model: str, samples: str, out: str) -> None:
    """Predictions of every detector that is saved under ``model``, one row for each sample and detector."""
    df = io.read_table(spark, samples, ["sample_id", "text"])
    found = []
    if io.exists(spark, f"{model}/svm"):
        found.append(models.predict_svm(df, models.load_model(f"{model}/svm"), models.load_model(f"{model}/curve"), "sample_id"))
    if io.exists(spark, f"{model}/trees"):
        found.append(models.predict_trees(df, models.load_model(f"{model}/trees"), "sample_id"))
    if io.exists(spark, f"{model}/perplexity"):
        rows = features.sentence_perplexities(df, "sample_id", "text", spark.read.parquet(f"{model}/perplexity/tokens"))
        threshold = io.read_manifest(spark, f"{model}/perplexity/threshold")["threshold"]
        found.append(models.predict_logistic(rows, models.load_model(f"{model}/perplexity/model"), "sample_id", threshold))
    if not found:
        raise FileNotFoundError(f"no detector under {model}")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    io.write_table(every, out)


def run_command(spark: SparkSession, source: str, out: str, config: PrepareConfig, detectors: tuple[str, ...] = DETECTORS, rounds: int = 120, targets: tuple[float, ...] = (0.01, 0.001)) -> None:
    """The whole way from wide rows to metrics: ``data``, ``models``, ``predictions`` and ``metrics`` under ``out``."""
    prepare_command(spark, source, f"{out}/set", config)
    io.write_table(spark.read.parquet(f"{out}/set/data"), f"{out}/samples.parquet")
    train_command(spark, f"{out}/samples.parquet", f"{out}/models", detectors, rounds)
    score_command(spark, f"{out}/models", f"{out}/samples.parquet", f"{out}/predictions.parquet")
    evaluate_command(spark, f"{out}/predictions.parquet", f"{out}/samples.parquet", f"{out}/metrics", list(targets))
