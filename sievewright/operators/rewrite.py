"""Bookkeeping of rewrite chains: token and cost estimates, usage, quality gates, checkpoints, variants, and the runner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cost
from ..functions.text import estimate_tokens, stable_id

#: Fixed prices in dollars per million tokens: (input, output).
PRICES = {"gpt-5.4": (2.5, 15.0), "gpt-5.4-mini": (0.75, 4.5), "gpt-5.4-nano": (0.2, 1.25)}
USAGE = ["requests", "input_tokens", "output_tokens", "total_tokens"]
RECORD = "sample_id string, depth_outputs map<int,string>, incremental_usage_by_depth map<int,struct<requests:bigint,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>"


def estimate_usage(df: DataFrame, by: list[str], prompt: Column, text: Column, depths: int) -> DataFrame:
    """Usage of each rewrite depth, running up over the depths; a request reads prompt text and writes text of the answer's length."""
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum(estimate_tokens(prompt)).alias("input_tokens"), F.sum(estimate_tokens(text)).alias("output_tokens"))
    base = base.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(depths))))
    out = base.select(*by, "depth", *[(F.col(c) * F.col("depth")).alias(c) for c in USAGE[:3]])
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


#: Tokens that the answer of a quality check is taken for.
QUALITY_OUTPUT = 64


def estimate_with_checks(df: DataFrame, by: list[str], prompt: Column, text: Column, depths: int, check: Column, checked: int) -> DataFrame:
    """Usage of each depth alone and run up, with the quality calls made at depth ``checked``: ``depth``, then for each number ``x``: ``x, cumulative_x, rewrite_x, quality_x``.

    ``prompt`` and ``check`` are the whole prompts of a rewriting and of a checking request; a check answers with ``QUALITY_OUTPUT`` tokens.
    """
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(estimate_tokens(prompt)).alias("input_tokens"), F.sum(estimate_tokens(text)).alias("output_tokens"), F.sum(estimate_tokens(check)).alias("_check_input"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    quality = {"requests": F.col("requests"), "input_tokens": F.col("_check_input"), "output_tokens": F.col("requests") * QUALITY_OUTPUT, "total_tokens": F.col("_check_input") + F.col("requests") * QUALITY_OUTPUT}
    rows = base.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(depths))))
    now, since = F.col("depth") == checked, F.col("depth") >= checked
    none = F.lit(0).cast("long")
    out = []
    for c in USAGE:
        out += [(F.col(c) + F.when(now, quality[c]).otherwise(none)).alias(f"_{c}"), (F.col(c) * F.col("depth") + F.when(since, quality[c]).otherwise(none)).alias(f"cumulative_{c}"), F.col(c).alias(f"rewrite_{c}"), F.when(now, quality[c]).otherwise(none).alias(f"quality_{c}")]
    return rows.select(*by, "depth", *out).withColumnsRenamed({f"_{c}": c for c in USAGE})


def usage_with_checks(calls: DataFrame, by: list[str]) -> DataFrame:
    """From ``calls(by.., depth, quality boolean, usage..)``: sums per depth of all, of rewriting and of quality calls, and the running sums of all and of rewriting."""
    sums = [F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long").alias(f"{name}{c}") for c in USAGE for name, cond in (("", F.lit(True)), ("rewrite_", ~F.col("quality")), ("quality_", F.col("quality")))]
    own = calls.groupBy(*by, "depth").agg(*sums)
    run = Window.partitionBy(*(by or [F.lit(0)])).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # a few depths
    return own.select("*", *[F.sum(f"{name}{c}").over(run).alias(f"cumulative_{name}{c}") for c in USAGE for name in ("", "rewrite_")])


def with_cost(df: DataFrame, model: str, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds ``cost`` at the model's prices."""
    table = PRICES | (prices or {})
    if model not in table:
        raise ValueError(f"no price for {model}")
    return df.withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens"), *[F.lit(x) for x in table[model]]))


def guard_budget(df: DataFrame, most: float | None) -> None:
    total = df.agg(F.max("cost")).first()[0] or 0.0
    if most is not None and total > most:
        raise ValueError(f"estimated cost {total:.2f} is above the budget of {most:.2f}")


def cumulative_usage(df: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """Sums per depth and their running sums over the depths."""
    own = df.groupBy(*by, depth).agg(*[F.sum(c).alias(c) for c in USAGE])
    run = Window.partitionBy(*(by or [F.lit(0)])).orderBy(depth).rowsBetween(Window.unboundedPreceding, 0)
    return own.select(*by, depth, *USAGE, *[F.sum(c).over(run).alias(f"cumulative_{c}") for c in USAGE])


def consecutive_depth(depths: Column) -> Column:
    """How many of the depths 1, 2, … are there without a gap."""
    # of the sorted distinct depths from 1 on those that are as large as their place
    own = F.array_sort(F.array_distinct(F.filter(depths, lambda x: x >= 1)))
    return F.size(F.filter(own, lambda x, i: x == i + 1)).cast("int")


def quality_summary(df: DataFrame, by: list[str], score: str, least: int) -> DataFrame:
    """Checked, passed, rejected and missing rows and how many have each score from 1 to 5."""
    s = F.col(score)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*by).agg(count(s.isNotNull()).alias("checked"), count(s >= least).alias("passed"), count(s < least).alias("rejected"), count(s.isNull()).alias("missing"), *[count(s == k).alias(f"score_{k}") for k in range(1, 6)])


def selected_depth(outputs: Column, depth: int, checked: int, score: Column, least: int) -> Column:
    """The depth to export: the wished one, unless its check failed; then the next lower one that is there, else 0."""
    lower = F.filter(F.map_keys(outputs), lambda d: d < depth)
    fallback = F.coalesce(F.array_max(lower), F.lit(0))
    failed = F.coalesce(score < least, F.lit(False)) if depth == checked else F.lit(False)
    return F.when(failed, fallback).otherwise(F.lit(depth))


def selected_text(outputs: Column, original: Column, chosen: Column) -> Column:
    return F.coalesce(F.try_element_at(outputs, chosen), original)


def variant_rows(df: DataFrame, model: str, depth: int, seed: int, text: Column) -> DataFrame:
    """Samples rewritten to a variant: new id, text, type and metadata; the old id becomes the parent."""
    new = stable_id(F.col("sample_id"), F.lit(model), F.lit(depth), F.lit(seed), text)
    meta = F.to_json(F.struct(F.lit(depth).alias("depth"), F.lit(model).alias("model"), F.lit(seed).alias("seed")))
    keep = [c for c in df.columns if c not in ("sample_id", "text", "variant_type", "parent_sample_id", "attack_name", "attack_metadata")]
    return df.select(new.alias("sample_id"), *keep, text.alias("text"), F.lit("rewrite").alias("variant_type"), F.col("sample_id").alias("parent_sample_id"), F.lit(f"recursive_rewrite_depth_{depth}").alias("attack_name"), meta.alias("attack_metadata"))


def run_chain(df: DataFrame, client: Callable[[], Callable[[str], str]], depths: int, done: DataFrame | None = None, retries: int = 5) -> DataFrame:
    """``sample_id, depth, text``: each depth rewrites the one before.

    ``client`` makes a rewriting function once a task; failures are tried again with growing pauses. Samples in ``done``
    with all depths are left out, so a run that stopped goes on from its checkpoint.
    """
    todo = df.select("sample_id", "text")
    if done is not None:
        todo = todo.join(done.groupBy("sample_id").agg(F.max("depth").alias("d")).filter(F.col("d") >= depths).select("sample_id"), "sample_id", "left_anti")

    def run(batches: Iterator) -> Iterator:
        import time

        import pandas as pd

        rewrite = client()

        def once(text: str) -> str:
            for k in range(retries):
                try:
                    return rewrite(text)
                except Exception:
                    if k + 1 == retries:
                        raise
                    time.sleep(min(2**k, 30))
            raise AssertionError

        for pdf in batches:
            rows = []
            for sid, text in zip(pdf["sample_id"], pdf["text"], strict=True):
                for depth in range(1, depths + 1):
                    text = once(text)
                    rows.append((sid, depth, text))
            yield pd.DataFrame(rows, columns=["sample_id", "depth", "text"])

    return todo.mapInPandas(run, "sample_id string, depth int, text string")
