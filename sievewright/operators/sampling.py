"""Seeded sampling, allocation and splitting.

Random order is the order of SHA-1 over seed and key ("hash order"): the same on every run and for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fresh
from .components import connected_components
from .ranges import numbered


def hash_order(seed: int, *keys: str) -> list[Column]:
    return [F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *[F.col(k) for k in keys]]


def take_per_group(df: DataFrame, by: list[str], n: Column | int, key: str, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of each group in hash order; ``n`` may be a column."""
    rank = fresh(df.columns, "_rn")
    if isinstance(n, int):  # a limit that Spark applies before the shuffle
        w = Window.partitionBy(*by).orderBy(*hash_order(seed, key))
        return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank)
    return numbered(df, by, hash_order(seed, key), rank).filter(F.col(rank) <= n).drop(rank)


def require_per_group(df: DataFrame, by: str, n: int) -> None:
    """Fails with the names of the groups that hold fewer than ``n`` rows."""
    small = [f"{r[0]} ({r[1]})" for r in df.groupBy(by).count().filter(F.col("count") < n).orderBy(by).limit(20).collect()]
    if small:
        raise ValueError(f"groups with fewer than {n} rows: {', '.join(small)}")


def sample_per_group(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    require_per_group(df, by, n)
    return take_per_group(df, [by], n, key, seed)


def sample_total(df: DataFrame, n: int, key: str, seed: int = 42, preserved: DataFrame | None = None) -> DataFrame:
    """``n`` rows without replacement; rows of ``preserved`` are in it and must exist in ``df``."""
    if preserved is None:
        return df.orderBy(*hash_order(seed, key)).limit(n)
    kept = preserved.select(key)
    if again := [str(r[0]) for r in kept.groupBy(key).count().filter("count > 1").limit(10).collect()]:
        raise ValueError(f"preserved ids repeat: {', '.join(again)}")
    if missing := [str(r[0]) for r in kept.join(df, key, "left_anti").limit(10).collect()]:
        raise ValueError(f"preserved ids that are not in the data: {', '.join(missing)}")
    rest = n - kept.count()
    if rest < 0:
        raise ValueError("more rows are preserved than asked for")
    pool = df.join(kept, key, "left_anti").orderBy(*hash_order(seed, key)).limit(rest)
    return df.join(kept, key, "left_semi").unionByName(pool)


def allocate(counts: DataFrame, group: str, total: Column) -> DataFrame:
    """Largest remainders: ``counts(group, n)`` to ``group, n, take`` with ``take`` adding up to ``total``; equal remainders go by name.

    Statistics of groups only; the window over all of them sees one row a group.
    """
    everything = Window.partitionBy(F.lit(0))
    share = total * F.col("n") / F.sum("n").over(everything)
    c = counts.withColumn("_floor", F.floor(share).cast("long")).withColumn("_part", F.round(share - F.floor(share), 12))
    left = total - F.sum("_floor").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc("_part"), F.col(group)))
    return c.withColumn("_left", left).withColumn("_rank", rank).select(group, "n", F.least("n", F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).alias("take"))


def fraction_target(n: Column, fraction: float) -> Column:
    """At least one, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(n * fraction).cast("long"))


def sample_fraction(df: DataFrame, group: str, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """A fraction of all rows, dealt to the groups by largest remainders."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_all", F.sum("n").over(everything))
    takes = allocate(counts, group, fraction_target(F.col("_all"), fraction))
    return take_per_group(df.join(takes.select(group, "take"), group), [group], F.col("take"), key, seed).drop("take")


def sample_stratified(df: DataFrame, by: list[str], fraction: float, key: str, seed: int = 42) -> DataFrame:
    """A fraction of each stratum, at least one row of it."""
    keys = [f"_key{i}" for i, _ in enumerate(by)]
    takes = df.groupBy(*by).agg(fraction_target(F.count(F.lit(1)), fraction).alias("_take")).toDF(*keys, "_take")
    on = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return take_per_group(df.join(takes, on).drop(*keys), by, F.col("_take"), key, seed).drop("_take")


def shard(df: DataFrame, by: str, order: str, shards: int) -> DataFrame:
    """Adds ``shard`` from 1: rows of a group are dealt in turn, in the given order."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return numbered(df, [by], [F.col(order)], "shard").withColumn("shard", ((F.col("shard") - 1) % shards + 1).cast("int"))


def group_components(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows joined by equal ``left`` or equal ``right`` values share ``group_id``, the smallest number of such a value.

    Values are numbered by hash; the bipartite graph of values is solved by ``connected_components``.
    """
    node = lambda side, c: F.xxhash64(F.lit(side), F.col(c))
    rows = df.withColumn("_l", node("l", left)).withColumn("_r", node("r", right))
    found = connected_components(rows.select(F.col("_l").alias("a"), F.col("_r").alias("b")))
    return rows.join(found.select(F.col("node").alias("_l"), F.col("component").alias("group_id")), "_l").drop("_l", "_r")


def group_splits(groups: DataFrame, group: str, stratum: str, test: float, val: float, seed: int = 42) -> DataFrame:
    """``group, split``: whole groups are dealt to test, val and train, stratified by largest remainders.

    ``groups`` has one row a group. Without strata of two groups each, or fewer places than strata, the order alone decides.
    """
    if not (0 < test < 1 and 0 < val < 1 and test + val < 1):
        raise ValueError("test and val must be positive fractions that leave something for train")
    everything = Window.partitionBy(F.lit(0))

    def quota(df: DataFrame, share: float) -> DataFrame:
        """Marks the groups of one side with ``_in``."""
        c = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
        c = c.withColumn("_size", F.ceil(F.round(F.sum("n").over(everything) * share, 9)).cast("long"))
        c = c.withColumn("_fits", (F.min("n").over(everything) >= 2) & (F.col("_size") >= F.count(F.lit(1)).over(everything)))
        fits, size = c.agg(F.max("_fits"), F.max("_size")).first()  # one row
        if not fits:
            placed = numbered(df, [], hash_order(seed, group), "_place")
            return placed.select(group, stratum, (F.col("_place") <= (size or 0)).alias("_in"))
        takes = allocate(c, stratum, F.col("_size")).select(stratum, "take")
        placed = numbered(df, [stratum], hash_order(seed, group), "_place").join(takes, stratum)
        return placed.select(group, stratum, (F.col("_place") <= F.col("take")).alias("_in"))

    first = quota(groups.select(group, stratum), test)
    rest = quota(first.filter("not _in").select(group, stratum), val / (1 - test))
    return first.filter("_in").select(group, F.lit("test").alias("split")).unionByName(rest.select(group, F.when(F.col("_in"), "val").otherwise("train").alias("split")))
