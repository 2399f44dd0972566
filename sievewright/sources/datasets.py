"""Text data sets by name: each is a view over a base table with a dense id, in a seeded order.

Views: ``human_answers`` and ``answer_pairs`` of wide question rows, ``language`` of translations, ``questions`` with long answers, and ``stories`` with their prompts. ``load``
finds a data set's table under a root folder, as ``<root>/<name>.<suffix>`` or as one file for each split, ``<root>/<name>/<split>.<suffix>``, and applies its view.

Defined cases: null cells are empty; answers are trimmed and blank ones dropped, cells that are no list have none; a row without a question gives its answer alone; of
pairs, the i-th answers of either side belong together, as many as the shorter side has; equal texts are several rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_list, detokenize, drop_prompt_tags, normal_strip, not_excluded, question_answer, words
from ..operators.ranges import numbered
from .io import SUFFIXES, exists, read_table, with_default_domain

#: Stands between a question and its answer, so that either can be cut off.
SEPARATOR = "<<<SEP>>>"
#: Words of a translation lie strictly between these.
FEWEST, MOST = 100, 150


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _answers(name: str) -> Column:
    """Trimmed texts of a list cell, blank ones dropped; lists that are decoded already are taken as they are."""
    return F.filter(F.transform(F.col(name), normal_strip), lambda x: x != "")


def _decoded(df: DataFrame, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({n: F.col(n) if kinds[n].startswith("array") else decode_list(F.col(n), "json") for n in names})


def seeded(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Adds ``id``, from 0, in the order of a hash of seed and key."""
    h = F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    done = numbered(df.withColumn("_h", h), [], [F.col("_h"), *[F.col(k) for k in key]], "_n")
    return done.select((F.col("_n") - 1).alias("id"), *[c for c in df.columns if c not in key], *[F.col(k).alias(f"source_{k}") for k in key])


def human_answers(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``text`` of every human answer of ``df(key, question, human_answers)``, tidied, with its question before it."""
    own = _decoded(df, "human_answers").select(key, normal_strip(_text("question")).alias("q"), F.posexplode(_answers("human_answers")).alias("answer", "a"))
    out = own.select(key, "answer", detokenize(question_answer(F.col("q"), F.col("a"))).alias("text")).filter("text <> ''")
    return seeded(out, [key, "answer"], seed)


def answer_pairs(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``original, sampled`` of the i-th human and machine answers of ``df(key, question, human_answers, chatgpt_answers)``."""
    own = _decoded(df, "human_answers", "chatgpt_answers").select(key, normal_strip(_text("question")).alias("q"), _answers("human_answers").alias("h"), _answers("chatgpt_answers").alias("m"))
    n = F.least(F.size("h"), F.size("m"))
    pairs = own.filter(n > 0).select(key, "q", F.posexplode(F.arrays_zip(F.slice("h", F.lit(1), n).alias("h"), F.slice("m", F.lit(1), n).alias("m"))).alias("answer", "p"))
    side = lambda c: detokenize(question_answer(F.col("q"), F.col(f"p.{c}")))
    out = pairs.select(key, "answer", side("h").alias("original"), side("m").alias("sampled")).filter("original <> '' and sampled <> ''")
    return seeded(out, [key, "answer"], seed)


def language(df: DataFrame, key: str, code: str, seed: int = 0) -> DataFrame:
    """``text`` of one language of ``df(key, translation)``, a struct or map by code, where it has more than ``FEWEST`` and fewer than ``MOST`` words."""
    text = F.coalesce(F.col("translation")[code], F.lit(""))
    plain = F.size(F.filter(words(F.regexp_replace(normal_strip(text), r"(?U)[\s\x1c-\x1f]+", " ")), lambda w: w != ""))
    return seeded(df.select(key, text.alias("text"), plain.alias("_w")).filter((F.col("_w") > FEWEST) & (F.col("_w") < MOST)).drop("_w"), [key], seed)


def questions(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``text`` of ``df(key, question, long_answer)``: both, with ``SEPARATOR`` before the answer."""
    return seeded(df.select(key, F.concat(F.lit("Question: "), _text("question"), F.lit(f" Answer:{SEPARATOR}"), _text("long_answer")).alias("text")), [key], seed)


def stories(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``text`` of ``df(key, prompt, story)``: the prompt without its tags, then the story, tidied; stories with an excluded mark are left out.

    Prompt and story are lines; the line end between them stays.
    """
    text = detokenize(F.concat(drop_prompt_tags(_text("prompt")), F.lit("\n "), _text("story")))
    return seeded(df.select(key, text.alias("text")).filter(not_excluded(F.col("text"))), [key], seed)


def aligned_lines(spark: SparkSession, prompts: str, texts: str) -> DataFrame:
    """``line, prompt, story`` of two text files whose lines belong together; lines that one file lacks are left out."""
    def lines(path: str, name: str) -> DataFrame:
        own = spark.read.text(path).select(F.col("value").alias(name), F.monotonically_increasing_id().alias("_i"))
        return numbered(own, [], [F.col("_i")], "line").select("line", name)

    return lines(prompts, "prompt").join(lines(texts, "story"), "line")


@dataclass(frozen=True)
class View:
    """What makes a data set of a table with a column ``key``."""

    make: Callable[[DataFrame, str, int], DataFrame]


NAMES: dict[str, View] = {}


def register(name: str, make: Callable[[DataFrame, str, int], DataFrame]) -> None:
    NAMES[name] = View(make)


for _name in ("hc3_all", "hc3_all_10000", "hc3_finance", "hc3_medicine", "hc3_qa", "hc3_eli5", "hc3_csai"):
    register(_name, human_answers)
for _name in ("avoidance_recursive_hc3", "hc3_stylisticCleanup", "hc3_perturbed"):
    register(_name, answer_pairs)
register("english", lambda df, key, seed: language(df, key, "en", seed))
register("german", lambda df, key, seed: language(df, key, "de", seed))
register("pubmed", questions)
register("writing", stories)


def resolve(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A table by its file, or by its name under ``root``; of a folder every split's file is read, and rows without a domain get the split's name."""
    if name.rpartition(".")[2].lower() in SUFFIXES:
        return read_table(spark, name)
    if root is None:
        raise ValueError(f"{name} is no file, and there is no root to look under")
    for kind in SUFFIXES:
        if exists(spark, f"{root}/{name}.{kind}"):
            return read_table(spark, f"{root}/{name}.{kind}")
    found: dict[str, DataFrame] = {}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder) if files.exists(folder) else []:
        split, _, kind = status.getPath().getName().rpartition(".")
        if split and kind.lower() in SUFFIXES and not split.startswith(("_", ".")):
            found[split] = with_default_domain(read_table(spark, status.getPath().toString()), split)
    if not found:
        raise FileNotFoundError(f"no table {name} under {root}")
    out = None
    for split in sorted(found):
        out = found[split] if out is None else out.unionByName(found[split], allowMissingColumns=True)
    return out


def load(spark: SparkSession, name: str, root: str, key: str | None = None, seed: int = 0) -> DataFrame:
    """The named data set; rows are told apart by ``key``, or by their place in Spark's order."""
    if name not in NAMES:
        raise ValueError(f"unknown data set {name}; known are {', '.join(sorted(NAMES))}")
    df = resolve(spark, name, root)
    if key is None:
        key = "_row"
        df = df.withColumn(key, F.monotonically_increasing_id())
    return NAMES[name].make(df, key, seed)
