"""A corpus pipeline of five stages over ``documents``; belongs to the subpackage ``sievewright.llm``.

Stages, in order: quality classifier (documents it rejects go), n-gram Jaccard join (of each group of near-duplicates one
row stays, that with the smallest id, whatever ids the rows repeat or lack), secret scans (found secrets are replaced in the text), mixing sources to target
weights (documents beyond their source's budget go), packing (token pieces in sequences). Every stage but the last returns
the columns of its input, extra ones too, with their values; only ``text`` and ``n_chars`` change where a secret was replaced.
Each stage's result is written and read again.

Defined cases of every stage: null text is empty (the secrets stage leaves it null); texts are read whole, whatever their length; ids may be null or
repeat, rows are judged one by one and equal rows are near-duplicates of each other; of rows with one id and order the first by text
stays; an empty table gives an empty table; columns of any other name are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import jaccard, mixing, packing, quality, secrets
from sievewright.llm.queries import mix_weights, tokenizer_path, with_domain
from sievewright.session import stored, table

#: The mix: the share of the tokens that stays, each document at most once.
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The document as one column ``row``, so that what an operator adds cannot clash, and the columns that the operator reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(carried(docs, "doc_id", "text"), model).filter("predicted = 1").select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # groups are of rows: an id may be null, or repeat with other texts
    numbered = carried(docs).withColumn("number", F.monotonically_increasing_id())
    rows = stored(numbered, "rows")
    found = jaccard.similar_sets(rows.select("number", "row.text"), words=5, percent=80, key="number").select("number", "component_id")
    values = [F.col("row").getField(c) for c in docs.columns]
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", F.sha2("row.text", 256), F.xxhash64(*values), "number")
    ordered = rows.select("number", order.alias("order")).join(found.hint("merge"), "number")
    kept = ordered.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.number").alias("number"))
    return rows.join(kept.hint("merge"), "number", "left_semi").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark, docs))
    clean = secrets.redact(secrets.scan(carried(docs, "text"), model))
    changed = F.size("found.spans") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = with_domain(carried(docs, "doc_id", "text", "lang", "source"))
    return mixing.mix(placed, ["domain", "lang", "source"], MIX_SHARE, mix_weights(spark), MIX_EPOCHS).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier's nor the tokenizer's stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
