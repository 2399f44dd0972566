"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

A tree of levels (domain, language, source) carries weights: the weight of a child is its share among its siblings,
one where none is given. The total token budget goes down the tree. At each node its children get
``min(capacity, share * weight)`` with one common factor, so that what a child cannot supply is redistributed
among its siblings first; as a parent never gets more than its subtree can supply, only a shortage of the whole
subtree reaches the parent's siblings. A leaf's capacity is its tokens times ``max_epochs``.

Each leaf takes the token-prefix of its seeded epochs: whole epochs as often as they fit, then the documents of one
more epoch, in the order of a seeded hash, whose tokens up to and including their own fit into what is left.

Data movement: documents are summed by (leaf, first four digits of the hash) with map-side combine, which gives slim rows. Running
sums over a leaf's ``16 ** 2`` coarse bins, then over the fine bins of the one on the border, tell which documents are
taken whole; only those of the fine bin on the border, a 65536-th of a leaf by hash, are sorted. The plan has a row for each leaf and is
broadcast if there are at most ``MOST_BROADCAST`` of them, so that the others are filtered in the scan and no text is shuffled;
with more leaves it is joined by a shuffle.

Defined cases: null levels are the leaf value ``''``; null or empty text has no tokens and is taken whenever an epoch of
its bin position is; equal hashes are ordered by id, rows repeated with the same id by text, equal rows one after the other; texts of any
length count whole; a zero or absent budget takes nothing but documents without tokens before the border; weights must
not be negative, and if all siblings have weight 0 they get nothing; an empty table gives an empty result; extra columns of any name are kept, but
those named ``tokens`` or ``epochs`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SEED = 42
#: A broadcast plan holds so many leaves at most, each of a few hundred bytes.
MOST_BROADCAST = 20_000


def tokens_of(text: Column) -> Column:
    """Cheap token count: a token for every four characters begun."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long")


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex digest of seed and parts; its text order is the order of an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def share(df: DataFrame, parent: list[str], capacity: str, weight: str, budget: str) -> DataFrame:
    """Adds ``granted``: ``min(capacity, factor * weight)`` among the rows of a parent, adding up to ``min(budget, sum of capacities)``.

    The children are filled in the order of capacity by weight: as long as the next one cannot take its share of what
    is left, it gets its capacity; the others share the rest by weight.
    """
    ratio = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(ratio, *[F.col(c) for c in df.columns if c not in (capacity, weight, budget)])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("_left", F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))).withColumn("_weights", F.sum(weight).over(rest))
    df = df.withColumn("_full", (F.col(weight) > 0) & (F.col("_left") * F.col(weight) >= F.col(capacity) * F.col("_weights")))
    # the first child that is not filled fixes the factor for all after it; what later rows would give is never larger
    factor = F.max(F.when(~F.col("_full") & (F.col("_weights") > 0), F.col("_left") / F.col("_weights"))).over(Window.partitionBy(*parent))
    open_at = F.max(F.when(~F.col("_full"), F.lit(1)).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    granted = F.when(open_at == 0, F.col(capacity)).when(F.col(weight) > 0, F.least(F.col(capacity), F.greatest(F.lit(0.0), F.coalesce(factor, F.lit(0.0))) * F.col(weight))).otherwise(F.lit(0.0))
    return df.withColumn("granted", granted).drop("_left", "_weights", "_full")


def leaf_budgets(leaves: DataFrame, levels: list[str], total_share: float, weights: list[DataFrame | None], max_epochs: int) -> DataFrame:
    """``leaves(levels.., tokens)`` to ``levels.., tokens, budget``. ``weights[i]`` has ``levels[: i + 1], weight``."""
    granted = None
    for i, _ in enumerate(levels):
        own, parent = levels[: i + 1], levels[:i] or ["_root"]
        nodes = leaves.groupBy(F.lit(0).alias("_root"), *own).agg((F.sum("tokens") * max_epochs).cast("double").alias("capacity"))
        if weights[i] is None:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        else:
            nodes = nodes.join(weights[i].withColumn("weight", F.col("weight").cast("double")), own, "left").fillna(1.0, ["weight"])
        if granted is None:  # the top level shares the whole budget, or all that there is
            everything = F.sum("capacity").over(Window.partitionBy("_root"))
            nodes = nodes.withColumn("budget", F.least(everything, F.floor(everything / max_epochs * total_share).cast("double")))
        else:
            nodes = nodes.join(granted, parent)
        granted = share(nodes, parent, "capacity", "weight", "budget").select(*own, F.col("granted").alias("budget"))
    # up to the rounding errors of the factor
    return leaves.join(granted, levels).select(*levels, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _border(bins: DataFrame, names: list[str], bin_name: str) -> DataFrame:
    """Of ``bins(names.., bin_name, bin_tokens, rest, start)`` the one of each leaf in which ``rest`` tokens end; ``start`` becomes the tokens before it."""
    before = Window.partitionBy(*names).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, -1)
    found = bins.withColumn("start", F.col("start") + F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))
    return found.filter((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("bin_tokens") > F.col("rest")))


def mix(
    docs: DataFrame,
    levels: list[str],
    total_share: float,
    weights: list[DataFrame | None] | None = None,
    max_epochs: int = 2,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """The documents that the mix takes, with ``tokens`` and ``epochs`` (how often each is taken, at least once).

    ``total_share`` is the budget as a share of all tokens of the table. ``levels`` name the tree's columns, top first.
    """
    weights = weights or [None] * len(levels)
    names = [f"level{i}" for i in range(len(levels))]
    own_weights = [w if w is None else w.toDF(*names[: i + 1], "weight") for i, w in enumerate(weights)]
    # the document is carried as one column, so that its columns' names are free
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("tokens", "epochs")]).alias("row"),
        *[F.coalesce(F.col(level).cast("string"), F.lit("")).alias(name) for name, level in zip(names, levels, strict=True)],
        tokens_of(F.col(text)).alias("tokens"),
        seeded_hash(seed, F.col(key)).alias("hash"),
        F.col(key).alias("key"),
        F.col(text).alias("text"),
    )
    fine_bin, coarse_bin = F.substring("hash", 1, 4).alias("fine"), F.substring("fine", 1, 2).alias("coarse")
    fine = stored(work.groupBy(*names, fine_bin).agg(F.sum("tokens").alias("bin_tokens")), "mix-bins").select("*", coarse_bin)
    coarse = fine.groupBy(*names, "coarse").agg(F.sum("bin_tokens").alias("bin_tokens"))
    leaves = coarse.groupBy(*names).agg(F.sum("bin_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, names, total_share, own_weights, max_epochs)
    plan = budgets.select(
        *names,
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
    )
    plan = stored(plan, "mix-plan")
    # the coarse bin in which a leaf's last epoch ends, then the fine one
    edge = _border(coarse.join(plan, names).withColumn("start", F.lit(0)), names, "coarse").select(*names, "coarse", "rest", "start")
    edge = _border(fine.join(edge.hint("merge"), [*names, "coarse"]), names, "fine").select(*names, F.col("fine").alias("edge"), "start")
    plan = stored(plan.join(edge, names, "left"), "mix-edges")
    placed = work.join(F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan.hint("merge"), names).withColumn("fine", fine_bin)
    at_edge = F.coalesce(F.col("fine") == F.col("edge"), F.lit(False))
    sure = placed.filter(~at_edge).withColumn("epochs", F.col("whole") + F.coalesce(F.col("fine") < F.col("edge"), F.lit(True)).cast("long"))
    upto = F.sum("tokens").over(Window.partitionBy(*names).orderBy("hash", "key", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = placed.filter(at_edge).withColumn("upto", F.col("start") + upto)
    last = last.withColumn("epochs", F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long"))
    return sure.select("row", "tokens", "epochs").unionByName(last.select("row", "tokens", "epochs")).filter("epochs > 0").select("row.*", "tokens", "epochs")
