"""Codes against a plain Lloyd iteration, and the defined cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from sievewright.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row string, _v int"


def lloyd(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector) in the order of the seeds; codes, errors and books by loops over single parts."""
    ints = [[max(-codes.MOST, min(codes.MOST, math.floor(scale * x))) for x in v] for _, v in rows]
    size = len(ints[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, part):
        return min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(part, books[p][e], strict=True)), e))

    for _ in range(rounds):
        said = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
        for p in range(parts):
            books[p] = [
                [sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v[p] for v, s in zip(cut, said, strict=True) if s[p] == e]) else old
                for e, old in enumerate(books[p])
            ]
    said = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(v[p], books[p][s[p]], strict=True)) for p in range(parts)) for v, s in zip(cut, said, strict=True)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return ["".join(f"{e:02x}" for e in s) for s in said], errors, hashlib.sha256(text.encode()).hexdigest()


def wide(x):
    return float(np.float32(x))


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_brute_force(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i * 3, [wide(rng.gauss(0, 1)) for _ in range(12)]) for i in range(90)]
    rows += [(500 + i, rows[5][1]) for i in range(200)] + [(900, [0.0] * 12), (901, [-0.0] * 12)]  # a hot group of copies
    df = spark.createDataFrame([(i, v, i % 3, None, None, None) for i, v in rows], SCHEMA).repartition(7)
    done, books = codes.compress(df, parts=4, entries=8, rounds=rounds)
    got = {r.vec_id: (r.code, r.error) for r in done.collect()}
    said, errors, digest = lloyd(rows, 4, 8, rounds)
    assert got == {i: (c, e) for (i, _), c, e in zip(rows, said, errors, strict=True)}
    assert codes.digest(books) == digest


def test_entries_without_parts_stay(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [9.0, 9.0])]
    done, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), parts=1, entries=3)
    assert books.tolist() == [[[256, 256], [256, 256], [2304, 2304]]]  # the second one never gets a part
    assert [r.code for r in done.orderBy("vec_id").collect()] == ["00", "00", "02"]


def test_defined_cases(spark):
    v = [0.5, -0.001, 2.0, 3.0]
    rows = [
        (None, v, 1, "x", "y", 7), (4, v, None, "x", "y", 7), (4, [1.0] * 4, None, "x", "y", 7), (4, [1.0] * 4, 2, "x", "y", 7), (2, None, 1, "x", "y", 7),
        (1, [1.0, None, 1.0, 1.0], 1, "x", "y", 7), (1, [float("nan")] * 4, 1, "x", "y", 7), (1, [float("inf")] * 4, 1, "x", "y", 7), (1, [], 1, "x", "y", 7),
        (0, [1.0] * 3, 1, "x", "y", 7), (8, [1.0] * 8, 1, "x", "y", 7), (9, [3e38, -3e38, 0.0, 0.0], 2, "x", "y", 7),
    ]
    done, books = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=2, entries=3)
    kept = [(4, v), (4, [1.0] * 4), (4, [1.0] * 4), (9, [3e38, -3e38, 0.0, 0.0]), (None, v)]
    said, errors, digest = lloyd(kept, 2, 3, 2)
    totals = codes.with_total(done, "label", "error", "label_error").collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in totals), key=str) == sorted(((i, c, e) for (i, _), c, e in zip(kept, said, errors, strict=True)), key=str)
    assert codes.digest(books) == digest and {(r["row"], r["_v"]) for r in totals} == {("y", 7)}
    by = {}
    for r in totals:
        by[r.label] = by.get(r.label, 0) + r.error
    assert all(by[r.label] == r.label_error for r in totals) and None in by


def test_empty(spark):
    done, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert done.count() == 0 and books.size == 0 and {"vec_id", "label", "code", "error"} <= set(done.columns)


def test_only_changed_parts_are_shuffled(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(c, 0.01) for _ in range(4)]) for i, c in enumerate([0, 10, 20, 30] * 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    work = df.select(codes.F.lit(0).alias("row"), codes.F.transform("embedding", lambda x: codes.F.floor(x * 256).cast("int")).alias("v"), codes.F.lit(None).cast("binary").alias("old"), codes.F.lit(None).cast("binary").alias("new"), codes.F.lit(None).cast("long").alias("error"))
    books = np.array([[[256 * c] * 2 for c in (0, 10, 20, 30)]] * 2, np.int64)
    first = codes.stored(codes.assign(work, books), "test")
    assert sum(r.n for r in codes.deltas(first, 2, 4, 2).collect()) == 2 * len(rows)
    again = codes.stored(codes.assign(first, books), "test")
    assert codes.deltas(again, 2, 4, 2).count() == 0
