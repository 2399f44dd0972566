"""Perturbed copies of texts: spans are masked, filled and put back, in rounds; a filling that fails is masked anew.

A round is a loop over a table that shrinks: texts whose masks could not be filled are masked again at other places, chosen by a hash of seed, round, attempt, key and
copy, until they are filled or ``tries`` attempts are over; then they stay as they were. Each attempt's table is written, so that filled texts are never
filled again, and an attempt works on the unfilled ones only. The next round perturbs what the round before gave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import apply_fills, count_masks, mask_spans, span_starts, words
from ..session import discard, stored

#: Adds ``fills``, a list of texts, one for each mask of ``masked``; too few, null or none at all is a failure.
Filler = Callable[[DataFrame], DataFrame]


def random_fills(vocabulary: list[str], span: int, seed: int) -> Filler:
    """A filler that needs no model: ``span`` words of a (bounded) vocabulary for each mask, by a hash of the seed and the place."""
    listed = F.split(F.lit("\x00".join(vocabulary)), "\x00")

    def fill(df: DataFrame) -> DataFrame:
        n = count_masks(F.col("masked"))
        pick = lambda i, k: F.get(listed, F.pmod(F.xxhash64(F.lit(seed), "round", "attempt", "key", "copy", i, F.lit(k)), F.lit(len(vocabulary))).cast("int"))
        every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat_ws(" ", *[pick(i, k) for k in range(span)]))
        return df.withColumn("fills", F.slice(every, F.lit(1), n))

    return fill


def _attempted(todo: DataFrame, fill: Filler, span: int, buffer: int, share: float, seed: int, turn: int, attempt: int) -> DataFrame:
    """``key, copy, text, filled, changed``: the text with its masks filled, null where they were not."""
    at = span_starts(F.size(words(F.col("text"))), span, buffer, share, F.lit(seed), F.lit(turn), F.lit(attempt), F.col("key"), F.col("copy"))
    masked = todo.withColumn("round", F.lit(turn)).withColumn("attempt", F.lit(attempt)).withColumn("starts", at)
    masked = masked.withColumn("masked", mask_spans(F.col("text"), F.col("starts"), span))
    answered = fill(masked)
    n = count_masks(F.col("masked"))
    enough = F.coalesce(F.size("fills") >= n, F.lit(False)) | (n == 0)
    own = F.when(n == 0, F.col("text")).otherwise(apply_fills(F.col("masked"), F.col("fills")))
    return answered.select("key", "copy", "text", F.when(enough, own).alias("filled"), n.cast("long").alias("spans"))


def perturb(df: DataFrame, key: str, text: str, fill: Filler, copies: int = 1, rounds: int = 1, span: int = 2, buffer: int = 1, share: float = 0.3, seed: int = 0, tries: int = 20) -> DataFrame:
    """``key, copy, text, attempts, spans, given_up``: ``copies`` perturbed texts of each row.

    ``attempts`` and ``spans`` (masks that were filled) are summed over the rounds, ``given_up`` counts the rounds that left the text as it was. Null texts are empty; a text too short for a
    span is filled at once; a text that holds masks of its own needs a fill for each of them too. Keys are unique.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    work = stored(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), each), "texts")
    counts = None
    for turn in range(rounds):
        done, todo = None, work
        held = []
        for attempt in range(tries):
            tried = stored(_attempted(todo, fill, span, buffer, share, seed, turn, attempt), "attempt")
            held.append(tried)
            ok = tried.filter("filled is not null").select("key", "copy", F.col("filled").alias("text"), F.lit(attempt + 1).cast("long").alias("attempts"), "spans", F.lit(0).cast("long").alias("given_up"))
            done = ok if done is None else done.unionByName(ok)
            todo = tried.filter("filled is null").select("key", "copy", "text")
            if todo.head() is None:
                break
        else:
            done = done.unionByName(todo.select("key", "copy", "text", F.lit(tries).cast("long").alias("attempts"), F.lit(0).cast("long").alias("spans"), F.lit(1).cast("long").alias("given_up")))
        after = stored(done, "round")
        discard(*held)  # the counts of earlier rounds are read at the end
        numbers = after.select("key", "copy", "attempts", "spans", "given_up")
        counts = numbers if counts is None else counts.unionByName(numbers)
        work = after
    total = counts.groupBy("key", "copy").agg(*[F.sum(c).alias(c) for c in ("attempts", "spans", "given_up")])
    return work.select("key", "copy", "text").join(total, ["key", "copy"]).withColumnRenamed("key", key)
