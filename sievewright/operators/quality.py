"""De-duplication, integrity checks and hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key, by an aggregate with map-side combine and no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def duplicate_summary(df: DataFrame, prompt_key: str, text_key: str, label: str) -> DataFrame:
    """One row: duplicates by text, by text and label, by prompt, text and label, and texts with several labels."""
    rows = F.count(F.lit(1))
    whole = df.agg(
        (rows - F.count_distinct(F.struct(text_key))).alias("duplicate_texts"),
        (rows - F.count_distinct(F.struct(text_key, label))).alias("duplicate_text_labels"),
        (rows - F.count_distinct(F.struct(prompt_key, text_key, label))).alias("duplicate_rows"),
    )
    conflicts = df.groupBy(text_key).agg(F.min(label).alias("a"), F.max(label).alias("b")).agg(F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).cast("long").alias("conflicting_texts"))
    return whole.join(F.broadcast(conflicts))  # one row each


def split_overlap(df: DataFrame, split: str, keys: dict[str, Column]) -> DataFrame:
    """``kind`` and the number of keys of that kind in two splits at once, for each pair of train, val and test; one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.xxhash64(c).alias("h"), c.cast("string").alias("v")) for k, c in keys.items()]))
    held = df.select(split, pairs.alias("k")).select(split, "k.*").groupBy("kind", "h", "v")
    inside = held.agg(*[F.max(F.when(F.col(split) == s, 1).otherwise(0)).alias(s) for s in ("train", "val", "test")])
    both = lambda a, b: F.sum(F.col(a) * F.col(b)).cast("long").alias(f"{a}_{b}")
    return inside.groupBy("kind").agg(both("train", "val"), both("train", "test"), both("val", "test"))


def check_integrity(df: DataFrame, split: str, prompt: Column, text: Column, label: str, deduplicated: bool = True) -> dict:
    """The summaries as a dictionary; fails if splits overlap, labels conflict or, where asked, duplicates are left."""
    keyed = df.withColumn("_p", prompt).withColumn("_t", text)
    dupes = duplicate_summary(keyed, "_p", "_t", label).first().asDict()
    overlap = {r["kind"]: {k: v for k, v in r.asDict().items() if k != "kind"} for r in split_overlap(keyed, split, {"prompt": F.col("_p"), "text": F.col("_t")}).collect()}
    wrong = [f"{kind}: {n} keys in {pair}" for kind, row in overlap.items() for pair, n in row.items() if n]
    if dupes["conflicting_texts"]:
        wrong.append(f"{dupes['conflicting_texts']} texts have several labels")
    if deduplicated and dupes["duplicate_text_labels"]:
        wrong.append(f"{dupes['duplicate_text_labels']} duplicates are left")
    if wrong:
        raise ValueError("; ".join(wrong))
    return dupes | {"overlap": overlap}


def hold_out(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys do not occur among the held-out ones; AQE broadcasts the keys if they are measured to be few."""
    return df.join(held.select(*keys).distinct(), keys, "left_anti")


def require_unique(df: DataFrame, key: str) -> None:
    if again := [str(r[0]) for r in df.groupBy(key).count().filter("count > 1").orderBy(key).limit(10).collect()]:
        raise ValueError(f"{key} repeats: {', '.join(again)}")


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails if the key repeats on either side."""
    require_unique(left, key)
    require_unique(right, key)
    return left.join(right, key, "left")


def with_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``occurrence``, the number from 0 of a row among those with its keys."""
    return numbered(df, keys, [F.col(order)], "occurrence").withColumn("occurrence", (F.col("occurrence") - 1).cast("int"))


def join_by_occurrence(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Joins the n-th row of a key with the n-th row of that key on the other side."""
    a, b = with_occurrence(left, keys, left_order), with_occurrence(right, keys, right_order)
    return a.join(b, [*keys, "occurrence"], "left")


def join_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Joins rows by position in either order; both sides must have the same length.

    Positions come from range-partitioned counts, not from one window over all rows.
    """
    if left.count() != right.count():
        raise ValueError("sides differ in length")
    return with_position(left, left_order).join(with_position(right, right_order), "position").drop("position")


def with_position(df: DataFrame, order: str) -> DataFrame:
    """Adds ``position`` from 0 in the order of a column with distinct values."""
    return numbered(df, [], [F.col(order)], "position").withColumn("position", F.col("position") - 1)


def misclassified(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows whose label and prediction differ; missing ones count as different."""
    return df.filter(F.col(label).isNull() | ~F.col(label).eqNullSafe(F.col(prediction)))


def two_level_lookup(rows: DataFrame, by_id: DataFrame, by_key: DataFrame, id_column: str, keys: list[str], value: str) -> DataFrame:
    """``value`` by id, else by key where that key has one value only; null if neither is known."""
    unique = by_key.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_by_key")).filter("_n = 1").drop("_n")
    found = rows.join(by_id.select(id_column, F.col(value).alias("_by_id")), id_column, "left").join(unique, keys, "left")
    return found.withColumn(value, F.coalesce("_by_id", "_by_key")).drop("_by_id", "_by_key")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n`` of several columns in one pass."""
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(sets.alias("s")).select("s.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
