"""Vector code compression by a delta-maintained Lloyd iteration.

Each component becomes the integer ``floor(scale * x)``; a vector is cut into equal consecutive parts, and each part is coded by the
number of the nearest entry of its position's codebook (squared Euclidean distance in integers, ties to the lower number). Codebooks
start as the parts of the rows with the smallest ids. A round assigns every part, then moves every entry to the componentwise floor of the
mean of its parts; an entry without parts stays.

Data movement: the integers are written once with the assignments of the round before. A round assigns in the scan and writes the new assignments
beside the old ones. Only parts whose assignment changed contribute: plus to the new entry, minus from the old one, summed in each task to
a row for each entry that changed there, so that a shuffle carries ``parts * entries`` rows a task at most, whatever the table's
size. The running sums and counts of all entries (as many rows as the codebooks have) are a written table too: a round adds the deltas to it.
To the driver go the sums, ``parts * entries`` rows, bounded by the parameters; from them come the codebooks that tasks get.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped, and so are vectors whose length is not that of the
first row kept, by id, that has a positive multiple of ``parts`` components; integers beyond ``MOST`` count as ``MOST``, so
that sums and errors stay in 64 bits; null ids come after all others as seeds; rows of one id are ordered by vector, equal rows are
several rows; with fewer rows than ``entries`` the codebooks are smaller; an empty table gives an empty result; other columns of
any name are kept, those named ``code`` or ``error`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fresh
from ..session import discard, stored
from .memory import frugal

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest magnitude of a component's integer.
MOST = 2**26
#: Vectors that are compared with a codebook at once.
BLOCK = 2048
#: Totals of so many groups at most, each of a few dozen bytes, are broadcast.
MOST_GROUPS = 50_000


def integers(df: DataFrame, vector: str, scale: int, name: str) -> DataFrame:
    """``df`` without rows that have no finite vector, and ``name``, the components' integers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return df.filter(x.isNotNull() & ok).withColumn(name, whole)


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``part`` to each entry, in integers."""
    out = np.zeros((len(part), len(book)), np.int64)
    for a, b in zip(part.T, book.T, strict=True):
        d = a[:, None] - b[None, :]
        out += d * d
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as integers, ``width`` to a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def codes_of(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def assign(work: DataFrame, books: np.ndarray) -> DataFrame:
    """Moves ``new`` to ``old`` and fills ``new`` and ``error``: the nearest entries and the sum of their distances. ``books`` are (parts, entries, components)."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                v = matrix(piece["v"], parts * size)
                nearest, error = np.empty((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
                for p in range(parts):
                    d = distances(v[:, p * size : (p + 1) * size], books[p])
                    nearest[:, p] = d.argmin(axis=1)  # the first of the least
                    error += d[np.arange(len(v)), nearest[:, p]]
                new = pa.array([x.tobytes() for x in nearest], pa.binary())
                yield pa.RecordBatch.from_arrays([piece["row"], piece["v"], piece["new"], new, pa.array(error)], names=["row", "v", "old", "new", "error"])

    return work.select("row", "v", "old", "new", "error").mapInArrow(frugal(run), work.schema)


def deltas(work: DataFrame, parts: int, entries: int, size: int) -> DataFrame:
    """``part, entry, n, sums``: what the changed assignments add to each entry and take from it, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, size + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch["v"], parts * size).reshape(-1, parts, size)
            ones = np.ones((len(v), parts, 1), np.int64)
            values = np.concatenate([ones, v], axis=2)
            new = codes_of(batch["new"], parts)
            first = batch["old"].is_null().to_numpy(zero_copy_only=False)
            old = codes_of(pa.array([x or bytes(parts) for x in batch["old"].to_pylist()]), parts)
            changed = first[:, None] | (new != old)
            place = np.arange(parts)[None, :] * entries
            np.add.at(total, (place + new)[changed], values[changed])
            gone = changed & ~first[:, None]
            np.subtract.at(total, (place + old)[gone], values[gone])
        moved = np.flatnonzero(total.any(axis=1))
        part, entry = (pa.array((x).astype(np.int32)) for x in (moved // entries, moved % entries))
        yield pa.RecordBatch.from_arrays([part, entry, pa.array(total[moved, 0]), pa.array(list(total[moved, 1:]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    changed = work.filter("old is null or old <> new").select("v", "old", "new")
    return changed.mapInArrow(frugal(run), "part int, entry int, n long, sums array<long>")


def summed(rows: DataFrame, size: int) -> DataFrame:
    """One row for each entry: ``part, entry, n, sums``."""
    sums = F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(size)])
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums"))


def moved(books: np.ndarray, totals: list) -> np.ndarray:
    """Entries at the floor of their parts' mean; those without parts stay."""
    out = books.copy()
    for r in totals:
        if r.n:
            out[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows without their vector, with ``code`` (two hex digits a part) and ``error``, and the codebooks (parts, entries, components)."""
    if not 0 < entries <= 256:
        raise ValueError(f"a part's code is one byte: {entries} entries do not fit")
    others = [c for c in df.columns if c not in (vector, "code", "error")]
    own = fresh(df.columns, "_v")
    kept = integers(df, vector, scale, own)
    first = [F.col(f"`{key}`").asc_nulls_last(), F.col(own)]
    fits = kept.filter((F.size(own) > 0) & (F.size(own) % parts == 0))
    head = fits.orderBy(*first).select(F.size(own).alias("n")).head()
    width = head.n if head else parts
    seeds = fits.filter(F.size(own) == width).orderBy(*first).limit(entries).select(own).collect()
    size = width // parts
    books = np.array([r[0] for r in seeds], np.int64).reshape(-1, parts, size).transpose(1, 0, 2)
    none = F.lit(None).cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    start = fits.filter(F.size(own) == width).select(row.alias("row"), F.col(own).alias("v"), none.alias("old"), none.alias("new"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return start.select("row.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    work, totals = stored(start, "vectors"), None
    for _ in range(rounds):
        done = stored(assign(work, books), "vectors")
        discard(work)
        change = deltas(done, parts, len(seeds), size)
        before = totals
        totals = stored(summed(change if before is None else before.unionByName(change), size), "sums")
        books = moved(books, totals.collect())  # parts * entries rows
        if before is not None:
            discard(before)
        work = done
    done = stored(assign(work, books), "vectors")
    discard(work)
    return done.select("row.*", F.lower(F.hex("new")).alias("code"), "error"), books


def with_total(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of equal ``by``, nulls together: summed in the scan, then joined, by broadcast where the groups are few."""
    group = fresh([*df.columns, name], "_group")
    totals = stored(df.groupBy(F.struct(F.col(f"`{by}`")).alias(group)).agg(F.sum(value).alias(name)), "totals")
    side = F.broadcast(totals) if totals.count() <= MOST_GROUPS else totals.hint("merge")
    return df.withColumn(group, F.struct(F.col(f"`{by}`"))).join(side, group).drop(group)
