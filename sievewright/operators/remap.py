"""Rows of shards and generated answers brought back to the rows of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_strip, normalize_space
from ..session import stored
from .features import counted, over_cores, pairs_of
from .quality import keep_first, require_columns, two_level_lookup
from .ranges import numbered

#: What tells a source row's identity.
IDENTITY = ["hc3_row_id", "source", "question"]


def identity(df: DataFrame) -> list[Column]:
    return [normalize_space(F.col(c).cast("string")).alias(f"_{c}") for c in IDENTITY]


def remap_rows(shards: DataFrame, rows: DataFrame, number: str = "row_index") -> DataFrame:
    """``shards`` with the number of the source row of the same identity, null if there is none; of equal identities the last number counts."""
    keys = [f"_{c}" for c in IDENTITY]
    known = rows.select(*identity(rows), F.col(number)).groupBy(*keys).agg(F.max(number).alias(number))
    return shards.select("*", *identity(shards)).join(known, keys, "left").drop(*keys)


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every normalised key."""
    return keep_first(rows, [normalize_space(F.col(k).cast("string")) for k in keys], [F.col(order)])


def merge_shards(rows: DataFrame, keys: list[str], shard: str, position: str) -> DataFrame:
    """Rows of all shards, of equal keys the one of the earliest shard and place; ``min_by`` combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(F.col(shard), F.col(position)))
    return rows.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def require_matched(rows: DataFrame, number: str, columns: list[str]) -> None:
    """Fails with the first five rows that have no number."""
    lost = rows.filter(F.col(number).isNull()).select(*columns).limit(5).collect()
    if lost:
        raise ValueError("rows that match no source row: " + ", ".join(" / ".join(str(v)[:60] for v in r) for r in lost))


def lookup_records(samples: DataFrame, records: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with their record's columns; a sample without a record fails the job with its key."""
    joined = samples.join(records.withColumn("_known", F.lit(True)), key, "left")
    checked = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no record for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn(key, checked).drop("_known")


def to_wide(frame: DataFrame, source: DataFrame, samples: DataFrame) -> DataFrame:
    """Generated answers (long) back to the source's wide rows: ``row_index, hc3_row_id, source, question, human_answers, chatgpt_answers``.

    ``frame(position, domain, prompt, text, label, sample_id, parent_sample_id)`` are samples, of which the parent's id counts for machine answers that have one;
    ``samples(sample_id, row_index, answer_order, text)`` are the source's own answers. A row's machine answers are, in this order: its
    generated ones, each normalised text once, in the order of the answers they replace; else, for each of its original answers, the first
    generated one that replaces an answer of that text anywhere; else the original ones. Rows that match no source row fail.
    """
    require_columns(frame, ["position", "domain", "prompt", "text", "label", "sample_id", "parent_sample_id"])
    label = F.lower(F.trim("label"))
    parent = F.nullif(F.trim(F.coalesce("parent_sample_id", F.lit(""))), F.lit(""))
    rows = frame.select("position", "text", label.alias("label"), F.when((label == "ai") & parent.isNotNull(), parent).otherwise(F.col("sample_id")).alias("sample_id"), normalize_space(F.col("domain")).alias("_d"), normalize_space(F.col("prompt")).alias("_p"))
    by_key = source.select(normalize_space(F.col("source")).alias("_d"), normalize_space(F.col("question")).alias("_p"), "row_index")
    placed = two_level_lookup(rows, samples.select("sample_id", "row_index"), by_key, "sample_id", ["_d", "_p"], "row_index")
    require_matched(placed, "row_index", ["sample_id", "_d", "_p"])
    known = samples.select("sample_id", "answer_order", normalize_space(F.col("text")).alias("_original"))
    text = normal_strip(F.col("text"))
    ai = placed.filter("label = 'ai'").join(known, "sample_id", "left").select("row_index", "_original", F.struct(F.coalesce("answer_order", "position").alias("o"), F.col("position").alias("p")).alias("at"), text.alias("text"), normalize_space(text).alias("_norm")).filter("_norm != ''")
    listed = lambda at, t: F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(t).alias("t")))), lambda s: s["t"])
    firsts = ai.groupBy("row_index", "_norm").agg(F.min_by("text", "at").alias("text"), F.min("at").alias("at"))
    direct = firsts.groupBy("row_index").agg(listed("at", "text").alias("_direct"))
    reuse = ai.filter("_original != ''").groupBy("_original").agg(F.min_by("text", "at").alias("text"))
    empty = source.join(direct, "row_index", "left_anti").select("row_index", F.posexplode("chatgpt_answers").alias("i", "answer")).withColumn("_original", normalize_space(F.col("answer"))).filter("_original != ''")
    once = empty.groupBy("row_index", "_original").agg(F.min("i").alias("i"))
    reused = once.join(reuse, "_original").groupBy("row_index").agg(listed("i", "text").alias("_reused"))
    out = source.join(direct, "row_index", "left").join(reused, "row_index", "left")
    return out.select("row_index", "hc3_row_id", "source", "question", "human_answers", F.coalesce("_direct", "_reused", "chatgpt_answers").alias("chatgpt_answers"))


def full_batches(df: DataFrame, order: str, batch: int) -> DataFrame:
    """The rows that fill whole batches, in the order of a column with distinct values; the rest goes."""
    from .quality import with_position

    most = df.count() // batch * batch
    return with_position(df, order).filter(F.col("position") < most).drop("position")


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each distinct value with the place where it comes first."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def source_summary(df: DataFrame, domain: str, human: str, ai: str) -> DataFrame:
    """Rows and answers of both sides for each domain, and for all of them under a null domain."""
    size = lambda c: F.sum(F.coalesce(F.array_size(c), F.lit(0))).cast("long")
    return df.rollup(domain).agg(F.count(F.lit(1)).alias("rows"), size(human).alias("human_answers"), size(ai).alias("ai_answers"))


def sample_tag(rows: int | None = None, fraction: float | None = None) -> str:
    if rows is not None:
        return f"rows{rows}"
    return "full" if fraction is None else f"frac{str(fraction).replace('.', 'p')}"


def selection_summary(sampled: DataFrame, domain: str, seed: int, rows: int | None = None, fraction: float | None = None, before: int | None = None, shards: int = 1, shard: int = 1) -> dict:
    """What was chosen and how; domains are few and come to the driver as counts."""
    by_domain = {str(r[0]): r["count"] for r in sampled.groupBy(domain).count().orderBy(domain).collect()}
    total = sum(by_domain.values())
    mode = "full_source" if rows is None and fraction is None else "balanced_source_rows" if rows is not None else "balanced_source_fraction"
    return {
        "seed": seed, "sample_rows": rows, "sample_fraction": fraction, "sampled_source_rows": total, "sampled_source_rows_by_domain": by_domain,
        "pre_shard_source_rows": total if before is None else before, "num_shards": shards, "shard_index": shard, "shard_tag": f"shard_{shard:02d}_of_{shards:02d}", "selection_mode": mode, "tag": sample_tag(rows, fraction),
    }


def changed_rate(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """``rows, changed, percent``: rows in which some element of the one array differs from its place in the other."""
    differs = F.exists(F.arrays_zip(F.col(before).alias("a"), F.col(after).alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(differs, F.lit(False)).cast("long")).alias("changed"))
    return counted.withColumn("percent", F.round(100 * F.try_divide("changed", "rows"), 1))


def run_counters(df: DataFrame, by: list[str], answers: str, attempts: str, changes: str) -> DataFrame:
    """Rows, answers, attempts and changes of a perturbation run."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).cast("long").alias(name) for name, c in (("answers", answers), ("attempts", attempts), ("changes", changes))])


def context_ranks(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, tokens, mean_rank, mean_log_rank``: the rank, from 1, of each token among those that follow the token before it in all documents, by frequency, then token."""
    # counted in each document's row first: frequent pairs are few rows; the texts' tokens are cut up by both readers, as pairs are larger than they
    own = over_cores(df).select(key, F.explode(counted(pairs_of(tokens))).alias("_c")).select(key, "_c.term.a", "_c.term.b", "_c.n")
    totals = stored(own.groupBy("a", "b").agg(F.sum("n").alias("total")), "pair-totals")
    ranks = numbered(totals, ["a"], [F.desc("total"), F.col("b")], "rank")
    # one number for a pair, told apart by 64 bits
    pair = F.xxhash64("a", "b").alias("pair")
    ranked = own.select(key, pair, "n").join(ranks.select(pair, "rank"), "pair")
    mean = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    return ranked.groupBy(key).agg(F.sum("n").alias("tokens"), mean(F.col("rank")).alias("mean_rank"), mean(F.log("rank")).alias("mean_log_rank"))


def parameter_grid(spark, **lists: list) -> DataFrame:
    """One row for each combination of the given lists, columns in their order."""
    out = None
    for name, values in lists.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)  # constants
    return out
