"""The base views that the registered queries run on, in Spark and as DuckDB text.

``qa``: turns of conversations as labelled answers; ``docs``: labelled documents; ``preds``: two deterministic detectors with tied scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_space
from ..session import table

QA_SQL = """
qa AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'human' ELSE 'ai' END AS label, 'd' || (conv_id % 5) AS domain, coalesce(text, '') AS text,
         coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prompt
  FROM conversations WHERE role IN ('user', 'assistant')
)"""

DOCS_SQL = """
docs AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, d.lang, d.source AS domain, d.n_chars, l.quality AS y, l.toxic,
         CASE WHEN d.doc_id % 10 < 2 THEN 'test' WHEN d.doc_id % 10 = 2 THEN 'val' ELSE 'train' END AS split
  FROM documents d JOIN labels l USING (doc_id)
)"""

PREDS_SQL = (
    DOCS_SQL
    + """, preds AS (
  SELECT 'coarse' AS detector, doc_id, domain, split, y, ((doc_id * 7919 + n_chars * 31) % 97) / 97.0::DOUBLE AS score FROM docs
  UNION ALL SELECT 'fine', doc_id, domain, split, y, ((doc_id * 104729) % 1009) / 1009.0::DOUBLE FROM docs
)"""
)


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "human").otherwise("ai").alias("label"),
        F.concat(F.lit("d"), (F.col("conv_id") % 5).cast("string")).alias("domain"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w), F.lit("")).alias("prompt"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 10
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("source").alias("domain"), "n_chars", F.col("quality").alias("y"), "toxic",
        F.when(m < 2, "test").when(m == 2, "val").otherwise("train").alias("split"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    coarse = ((F.col("doc_id") * 7919 + F.col("n_chars") * 31) % 97) / F.lit(97.0)
    fine = ((F.col("doc_id") * 104729) % 1009) / F.lit(1009.0)
    both = F.explode(F.array(F.struct(F.lit("coarse").alias("detector"), coarse.alias("score")), F.struct(F.lit("fine").alias("detector"), fine.alias("score"))))
    return d.select("doc_id", "domain", "split", "y", both.alias("p")).select("p.detector", "doc_id", "domain", "split", "y", "p.score")


def normal(c):
    """Normalised text of a column or name."""
    return normalize_space(F.col(c) if isinstance(c, str) else c)


#: DuckDB text of ``normalize_space``.
def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
