"""Wide question rows to answer samples and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space, stable_id

#: Fixed names that the readers accept for one field, in order of preference.
SYNONYMS = {
    "domain": ["domain", "source", "category"],
    "prompt": ["question", "prompt", "instruction"],
    "human": ["human_answers", "human", "human_response", "human_text", "reference"],
    "ai": ["chatgpt_answers", "ai_answers", "machine_answers", "gpt_answers", "model_answers"],
    "source_model": ["source_model", "model"],
}
SAMPLE_COLUMNS = ["sample_id", "dataset", "domain", "prompt", "text", "label", "source_model", "split", "variant_type", "parent_sample_id", "attack_name", "attack_metadata"]
DEFAULTS = {"variant_type": "original", "attack_metadata": "{}"}


def synonym(df: DataFrame, field: str, default: str | None = None) -> Column:
    """The first of the field's columns that is there and not empty."""
    found = [F.nullif(F.col(c), F.lit("")) if df.schema[c].dataType.simpleString() == "string" else F.when(F.size(c) > 0, F.col(c)) for c in SYNONYMS[field] if c in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def ensure_sample_schema(df: DataFrame) -> DataFrame:
    """The sample columns in their order; missing ones get their default."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(DEFAULTS.get(c)).cast("string").alias(c) for c in SAMPLE_COLUMNS])


def explode_answers(df: DataFrame, keys: list[str], human: str, ai: str) -> DataFrame:
    """A row for each answer: ``keys, label, answer_index, text``; blank answers go and do not count."""
    clean = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), normalize_space), lambda x: x != "")
    both = F.array(F.struct(F.lit("human").alias("label"), clean(human).alias("answers")), F.struct(F.lit("ai").alias("label"), clean(ai).alias("answers")))
    sides = df.select(*keys, F.explode(both).alias("side"))
    return sides.select(*keys, F.col("side.label").alias("label"), F.posexplode("side.answers").alias("answer_index", "text"))


def to_samples(df: DataFrame, row_index: str, dataset: str) -> DataFrame:
    """Answer-level samples with stable ids from wide rows; ``row_index`` is the row's number in the source."""
    wide = df.select(
        F.col(row_index).alias("_row"),
        normalize_space(synonym(df, "domain", "unknown")).alias("domain"),
        normalize_space(synonym(df, "prompt", "")).alias("prompt"),
        synonym(df, "source_model", "chatgpt").alias("_model"),
        synonym(df, "human").alias("_human"),
        synonym(df, "ai").alias("_ai"),
    )
    long = explode_answers(wide, ["_row", "domain", "prompt", "_model"], "_human", "_ai")
    sid = stable_id(F.lit(dataset), F.col("domain"), F.col("prompt"), F.col("text"), F.col("label"), F.col("_row"), F.col("answer_index"))
    return ensure_sample_schema(long.select("*", sid.alias("sample_id"), F.lit(dataset).alias("dataset"), F.when(F.col("label") == "ai", F.col("_model")).otherwise("human").alias("source_model")))


def unique_in_order(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """The first row of each normalised text of a group."""
    w = Window.partitionBy(*by, normalize_space(F.col(text))).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def renest(df: DataFrame, by: list[str], label: str, text: str, order: str) -> DataFrame:
    """Lists of unique texts in order, one column a label; a label without texts has an empty list."""
    first = unique_in_order(df, [*by, label], text, order)
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(label) == name, F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda s: s["t"])
    return first.groupBy(*by).agg(listed("human").alias("human_answers"), listed("ai").alias("ai_answers"))


def zip_pairs(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Pairs of the i-th items of both lists, as many as the shorter one has."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(F.slice(F.col(left), F.lit(1), n).alias("original"), F.slice(F.col(right), F.lit(1), n).alias("sampled"))
    some = df.filter((F.size(left) > 0) & (F.size(right) > 0))
    return some.select(*keys, F.posexplode(pairs).alias("pair", "_p")).select(*keys, "pair", "_p.original", "_p.sampled")


def group_signature(df: DataFrame, group: str, domain: str, label: str) -> DataFrame:
    """Each group's most frequent domain (the lowest on ties) and its labels joined by ``+``."""
    return df.groupBy(group).agg(F.expr(f"mode({domain}, true)").alias("domain"), F.array_join(F.array_sort(F.collect_set(label)), "+").alias("labels"))
