"""Suffix arrays and removal against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import suffixes as S


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, anchor string")
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, **options).collect()], key=str)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    letters = b"ab\x00" if seed % 2 else b"abcdefgh"
    pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(8)] + [b"a" * 50, b"a" * 37, b""]
    pieces += [pieces[0] + b"zz" + pieces[1]]
    depth = rng.choice([8, 12, 16, 24, 40])
    order, common, begin = S.suffix_array(pieces, depth)
    text = {int(begin[k]) + i: p[i : i + depth] for k, p in enumerate(pieces) for i in range(len(p) + 1)}
    got = [text[i] for i in order.tolist()]
    assert sorted(order.tolist()) == sorted(text) and got == sorted(got)
    for a, b, c in zip(got, got[1:], common[1:].tolist(), strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert n == c


@pytest.mark.parametrize("most", [512, 2])
def test_against_brute_force(spark, most):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            text = text[: rng.randint(0, 50)] + passage + text
        if i % 7 == 0 and rows:
            text = rows[-1][1] or ""
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "z" * 900), (103, "y" * 199), (None, passage), (5, passage), (5, passage), (104, passage[50:] + passage), (105, "ab" * 150)]
    assert run(spark, rows, most_contexts=most) == brute(rows, 200)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows, 200)


def test_empty(spark):
    assert run(spark, []) == []
