"""Evaluation of binary classifiers: confusion counts, curves and operating points, for any grouping columns.

Scores are aggregated to one row per group and distinct score with map-side combine; their running counts come from ranges of scores
(``ranges.running``), so that no task holds all scores of a group, however many are distinct. ``y`` is 1 for positives. Rows whose score or label is missing or not a number are left out of curves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import metric_name, ratio
from ..session import stored
from .ranges import running

COUNTS = ["tn", "fp", "fn", "tp"]


def _hit(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def with_rates(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 from the counts; a ratio over nothing is 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return df.select("*", ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(df: DataFrame, by: list[str], threshold: Column | float = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    """Counts and rates at a threshold (a number or an expression); predicted positive where ``score >= threshold``."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    said, real = F.col(score) >= t, F.col(y) == 1
    return with_rates(df.groupBy(*by).agg(_hit(~said & ~real).alias("tn"), _hit(said & ~real).alias("fp"), _hit(~said & real).alias("fn"), _hit(said & real).alias("tp")))


def median_threshold(df: DataFrame, by: list[str], column: str = "decision_threshold", default: float = 0.5) -> DataFrame:
    """Each group's median decision threshold; the default where there is none."""
    v = F.col(column).try_cast("double")
    return medians(df.select(*by, F.when(~F.isnan(v), v).alias("_v")), by, "_v").select(*by, F.coalesce("median", F.lit(default)).alias("threshold"))


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by.., median`` of each group's values that are not null; null where it has none. Ranks come from ranges: no task holds a group's values."""
    counted = stored(df.groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n")), "values")
    own = counted.filter("_x is not null")
    totals = own.groupBy(F.struct(*by, F.lit(0)).alias("_g")).agg(F.sum("_n").alias("_total"))
    run = running(own, by, [F.col("_x")], {"_upto": F.col("_n")}).withColumn("_g", F.struct(*by, F.lit(0))).join(totals, "_g")
    # the two middle places, which are one for an odd number
    holds = lambda p: (F.col("_upto") >= p) & (F.col("_upto") - F.col("_n") < p)
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = run.groupBy("_g").agg(((F.max(F.when(holds(low), F.col("_x"))) + F.max(F.when(holds(high), F.col("_x")))) / 2).alias("median"))
    groups = counted.select(*by).distinct().withColumn("_g", F.struct(*by, F.lit(0)))
    return groups.join(middle, "_g", "left").drop("_g")


def evaluate(df: DataFrame, by: list[str], y: str = "y", score: str = "score", threshold: str = "decision_threshold") -> DataFrame:
    """Counts and rates of each group at its own median threshold."""
    keys = [f"_key{i}" for i, _ in enumerate(by)]
    chosen = median_threshold(df, by, threshold).toDF(*keys, "threshold")
    on = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    joined = df.select(*by, F.col(y).alias("y"), F.col(score).alias("score")).join(chosen, on).drop(*keys)
    return confusion(joined, [*by, "threshold"], F.col("threshold"))


def score_table(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """One row per group and distinct score, from the highest: own counts (p, n), running counts (tp, fp), totals, and the own counts of the score below (next_p, next_n)."""
    clean = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(y).isNotNull())
    # written, as dealing to ranges reads it twice and the totals once more
    own = stored(clean.groupBy(*by, F.col(score).alias("threshold")).agg(_hit(F.col(y) == 1).alias("p"), _hit(F.col(y) != 1).alias("n")), "scores")
    run = running(own, by, [F.desc("threshold")], {"tp": F.col("p"), "fp": F.col("n")}, {"next_p": F.col("p"), "next_n": F.col("n")})
    totals = own.groupBy(F.struct(*by, F.lit(0).alias("_all")).alias("_g")).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return run.withColumn("_g", F.struct(*by, F.lit(0).alias("_all"))).join(totals, "_g").drop("_g")


def roc_points(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """The curve's points ``fpr, tpr, threshold`` with counts; points on a straight line between their neighbours are dropped.

    The origin with an infinite threshold comes first. Groups with one class have no rows.
    """
    t = score_table(df, by, y, score).filter("positives > 0 and negatives > 0")
    # where the counts of the score below are the same, the curve goes straight on; the first and the last point stay
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    turns = F.col("next_p").isNull() | (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))
    kept = t.filter(first | turns).select(*by, "threshold", "tp", "fp", "positives", "negatives")
    origin = kept.groupBy(*by, "positives", "negatives").agg(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    points = kept.unionByName(origin)
    return points.select(*by, ratio(F.col("fp"), F.col("negatives")).alias("fpr"), ratio(F.col("tp"), F.col("positives")).alias("tpr"), "threshold", "tp", "fp", "positives", "negatives")


def roc_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve; NaN for one class. Each positive beats the negatives below it and half of those beside it."""
    t = score_table(df, by, y, score)
    won = F.sum(F.col("p") * (2 * (F.col("negatives") - F.col("fp")) + F.col("n")))
    pairs = (F.col("positives") * F.col("negatives")).cast("double")
    return t.groupBy(*by, "positives", "negatives").agg(won.alias("_won")).select(*by, F.when(pairs == 0, float("nan")).otherwise(F.try_divide(F.col("_won"), 2 * pairs)).alias("roc_auc"))


def pr_points(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0)."""
    t = score_table(df, by, y, score).filter("positives > 0")
    points = t.select(*by, ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"), "threshold")
    return points.unionByName(t.select(*by).distinct().select(*by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(float("inf")).alias("threshold")))


def pr_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under precision by recall; the point before a score's own follows from its counts, the end point (1, 0) is the first."""
    t = score_table(df, by, y, score).filter("positives > 0")
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    before = F.when(tp + fp == p + n, 1.0).otherwise(ratio(tp - p, tp - p + fp - n))
    return t.groupBy(*by).agg(F.sum((ratio(tp, tp + fp) + before) / 2 * ratio(p, F.col("positives"))).alias("pr_auc"))


def _at_point(points: DataFrame, by: list[str], order: Column) -> DataFrame:
    best = points.groupBy(*by).agg(F.max_by(F.struct("threshold", "fpr", "tpr", "tp", "fp", "positives", "negatives"), order).alias("o"))
    chosen = best.select(*by, "o.*").withColumn("fn", F.col("positives") - F.col("tp")).withColumn("tn", F.col("negatives") - F.col("fp"))
    return with_rates(chosen).select(*by, "threshold", "fpr", "tpr", *COUNTS, "accuracy", "precision", "recall", "f1")


def operating_point_a(points: DataFrame, by: list[str], target: float) -> DataFrame:
    """Of the curve's points with ``fpr <= target`` the one with the largest tpr, then the largest fpr."""
    return _at_point(points.filter(F.col("fpr") <= target), by, F.struct("tpr", "fpr"))


def operating_point_b(points: DataFrame, by: list[str], target: float) -> DataFrame:
    """As A, but the first such point: of equal tpr the smallest fpr; the nearest fpr if none is low enough."""
    ok = F.col("fpr") <= target
    far = F.when(ok, 0.0).otherwise(-F.abs(F.col("fpr") - target))
    return _at_point(points, by, F.struct(ok.alias("a"), far.alias("b"), F.when(ok, F.col("tpr")).otherwise(0.0).alias("c"), (-F.col("fpr")).alias("d"), F.col("threshold").alias("e")))


def operating_point_c(df: DataFrame, by: list[str], target: float, y: str = "y", raw: str = "raw") -> DataFrame:
    """For raw scores where low means positive: of the cuts with ``fpr <= target`` the largest (f1, recall, -fpr), the last on ties.

    Predicted positive where ``raw < threshold``; thresholds lie just above a score, and one predicts no positive.
    """
    eps = 1e-12
    t = score_table(df.withColumn("_s", -F.col(raw)), by, y, "_s")
    cuts = t.select(*by, (-F.col("threshold") + eps).alias("threshold"), "tp", "fp", "positives", "negatives")
    none = t.groupBy(*by, "positives", "negatives").agg(F.min(-F.col("threshold")).alias("threshold")).select(*by, (F.col("threshold") - eps).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "positives", "negatives")
    points = cuts.unionByName(none).select("*", ratio(F.col("fp"), F.col("negatives")).alias("fpr"), ratio(F.col("tp"), F.col("positives")).alias("tpr"))
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))
    return _at_point(points.filter(F.col("fpr") <= target + eps), by, F.struct(f1.alias("a"), F.col("tpr").alias("b"), (-F.col("fpr")).alias("c"), F.col("threshold").alias("d")))


def operating_point_d(curve: DataFrame, by: list[str], target: float, positives: str = "positives", negatives: str = "negatives") -> DataFrame:
    """From stored curve rows ``fpr, tpr, threshold``: rates times class sizes give fractional counts; an infinite threshold is 0."""
    best = curve.filter(F.col("fpr") <= target).groupBy(*by, positives, negatives).agg(F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct("tpr", "fpr")).alias("o")).select(*by, "o.*", positives, negatives)
    tp, fp = F.col("tpr") * F.col(positives), F.col("fpr") * F.col(negatives)
    total = F.col(positives) + F.col(negatives)
    precision = ratio(tp, tp + fp)
    thr = F.when(F.abs(F.col("threshold")) == float("inf"), 0.0).otherwise(F.col("threshold"))
    return best.select(*by, thr.alias("threshold"), "fpr", "tpr", ratio(tp + F.col(negatives) - fp, total).alias("accuracy"), precision.alias("precision"), ratio(2 * precision * F.col("tpr"), precision + F.col("tpr")).alias("f1"))


def tpr_at(points: DataFrame, by: list[str], target: float) -> DataFrame:
    return points.groupBy(*by).agg(F.max(F.when(F.col("fpr") <= target, F.col("tpr"))).alias("tpr"))


def fpr_at_tpr(points: DataFrame, by: list[str], target: float = 0.8) -> DataFrame:
    """Smallest fpr with ``tpr >= target``, 0 if none."""
    return points.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("tpr") >= target, F.col("fpr"))), F.lit(0.0)).alias("fpr"))


def best_f1_threshold(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Of all distinct scores and 0.5 the threshold with the largest (f1, accuracy, precision, recall), the lowest on ties; 0.5 for one class."""
    t = score_table(df, by, y, score)
    fixed = t.groupBy(*by, "positives", "negatives").agg(
        F.sum(F.when(F.col("threshold") >= 0.5, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("threshold") >= 0.5, F.col("n")).otherwise(0)).alias("fp")
    ).withColumn("threshold", F.lit(0.5))
    every = t.select(*by, "threshold", "tp", "fp", "positives", "negatives").unionByName(fixed)
    every = with_rates(every.withColumn("fn", F.col("positives") - F.col("tp")).withColumn("tn", F.col("negatives") - F.col("fp")))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    best = F.max_by(F.col("threshold"), F.struct("f1", "accuracy", "precision", "recall", -F.col("threshold")))
    return every.groupBy(*by).agg(F.when(F.max(both), best).otherwise(0.5).alias("threshold"), F.max("f1").alias("best_f1"))


def metrics_at_targets(df: DataFrame, by: list[str], targets: list[float], y: str = "y", score: str = "score") -> DataFrame:
    """Rule A at each target as columns named by metric and target."""
    points = roc_points(df, by, y, score)
    out = None
    for t in targets:
        part = operating_point_a(points, by, t)
        part = part.select(*by, *[F.col(c).alias(metric_name("actual_fpr" if c == "fpr" else c, t)) for c in ("threshold", "fpr", "tpr", "accuracy", "precision", "recall", "f1")])
        out = part if out is None else out.join(part, by, "outer")
    return out


def binary_block(df: DataFrame, by: list[str], threshold: float, targets: list[float], y: str = "y", score: str = "score") -> DataFrame:
    """One row a group: counts and rates at a threshold, ``num_samples``, ``roc_auc`` and the columns of each fixed-FPR target."""
    counted = confusion(df, by, threshold, y, score).withColumn("num_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    out = counted.join(roc_auc(df, by, y, score), by, "left")
    return out.join(metrics_at_targets(df, by, targets, y, score), by, "left") if targets else out


def nested(df: DataFrame, by: list[str], inner: str, threshold: float = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    """Counts and rates of each group (``whole`` is 1) and of each ``inner`` value inside it (0), by grouping sets over one scan; nulls are groups."""
    said, real = F.col(score) >= threshold, F.col(y) == 1
    cells = df.groupingSets([by, [*by, inner]], *by, inner)
    counted = cells.agg(F.grouping(inner).cast("int").alias("whole"), _hit(~said & ~real).alias("tn"), _hit(said & ~real).alias("fp"), _hit(~said & real).alias("fn"), _hit(said & real).alias("tp"))
    return with_rates(counted)


def roc_comparison(points: DataFrame, detector: str, dataset: str, datasets: list[str], labels: dict[str, str]) -> DataFrame:
    """``label, dataset, fpr, tpr``: curves of the chosen data sets, detectors under their labels, the upper end of each vertical step."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col(detector)), F.col(detector)) if labels else F.col(detector)
    return points.filter(F.col(dataset).isin(datasets)).groupBy(named.alias("label"), dataset, "fpr").agg(F.max("tpr").alias("tpr"))


#: Fixed thresholds of the perplexity-ratio detector; a machine text scores below.
RATIO_THRESHOLDS = {"accuracy": 0.9015310749276843, "low_fpr": 0.8536432310785527}


def ratio_decisions(score: Column) -> dict[str, Column]:
    return {name: score < t for name, t in RATIO_THRESHOLDS.items()}


def require_targets(targets: list[float]) -> list[float]:
    """Targets between 0 and 1, each once, in their order."""
    if wrong := [t for t in targets if not 0 < t < 1]:
        raise ValueError(f"rates must lie between 0 and 1: {wrong}")
    return list(dict.fromkeys(targets))
