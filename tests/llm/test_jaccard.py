"""The join against all pairs, its plan's pigeonhole, and components."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import jaccard as J
from sievewright.operators.components import connected_components


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in nodes}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.append((i, j))
    found = components_of(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def run(spark, rows, k, percent):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    found = J.similar_sets(df, k, percent).collect()
    assert len(found) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50), (1, 30), (2, 10)])
def test_against_all_pairs(spark, monkeypatch, k, percent):
    monkeypatch.setattr(J, "SLOT_BYTES", 4000)
    monkeypatch.setattr(J, "SLICE_BYTES", 3000)
    rng = random.Random(k)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(160):
        n = rng.choice([0, 1, 2, 4, 6, 9, 12, 20, 60, 150])
        text = [rng.choice(words) for _ in range(n)]
        if rows and rng.random() < 0.6:
            text = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, "\t ".join(text).upper() if i % 2 else " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n\x0b\x0c"), (903, "One"), (904, "oNE "), (905, "É é"), (906, "é é"), (907, "\x1c a")]
    assert run(spark, rows, k, percent) == brute(rows, k, percent)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def kept_keys(s, percent, order):
    """The keys that a set keeps under an order of keys (the first ones are left out first)."""
    out = set()
    for band, plain, drop, other in J.keys_of(s, percent):
        ranked = sorted(plain.tolist(), key=order)
        out |= {(band, k) for k in ranked[drop:]} | {(band, k) for k in other.tolist()}
    return out


@pytest.mark.parametrize("percent", [10, 30, 50, 80, 90])
def test_similar_sets_share_a_kept_key_under_any_order(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for turn in range(1500):
        n = int(rng.integers(1, 12 if turn % 2 else 400))
        s = rng.integers(0, 2**63, 11 * n + 50).astype(np.uint64)
        a = np.unique(s[:n])
        drop = int(rng.integers(0, max(1, (100 - percent) * n // 100) + 1))
        add = int(rng.integers(0, max(1, n * (100 - percent) // percent) + 1))
        b = np.unique(np.concatenate([a[drop:], s[n : n + add]]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            met += 1
            order = lambda k, salt=turn: hash((k, salt))
            assert kept_keys(a, percent, order) & kept_keys(b, percent, order)
    assert met > 100


def test_screen_keeps_every_similar_pair():
    rng = np.random.default_rng(4)
    sets = []
    for k in range(160):
        s = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64)) if k % 3 == 0 or not sets else sets[-1][int(rng.integers(0, 6)) :]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)])))
    sketches = [J.sketch(s).tobytes() for s in sets]
    for percent in (10, 30, 50, 80, 90):
        for a in range(160):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                true = 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
                assert J.similar(sets[a].tobytes(), sets[b].tobytes(), percent) == true
                if true:
                    assert J.may_be_similar(len(sets[a]), sketches[a], len(sets[b]), sketches[b], percent)


def test_group_of_near_copies_and_one_very_long_text(spark):
    rng = random.Random(8)
    base = [str(k) for k in range(80)]
    rows = [(i, " ".join([*base[:40], f"x{i}", *base[40:]])) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(base) for _ in range(30)) + " " + " ".join(base)) for i in range(40)]
    long = [f"l{k}" for k in range(40_000)]
    rows += [(2000, " ".join(long)), (2001, " ".join(long[:-2000])), (2002, " ".join(long[10_000:]))]
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.component_id) for r in J.similar_sets(df).collect()), key=str)
    assert found == [(0, None), (1, 1), (2, 1), (2, 1)]
    assert J.similar_sets(df.limit(0)).count() == 0


@pytest.mark.parametrize("last", [2, 7])
def test_rows_of_one_id_have_one_component(spark, last):
    x, y = "a b c d e f", "g h i j k l"
    rows = [(3, x), (5, x), (5, y), (last, y), (5, ""), (last, None), (8, ""), (9, x + " m"), (9, "n"), (10, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in J.similar_sets(df).collect()}
    least = min(3, last)
    assert found == {(3, least), (5, least), (last, least), (8, 8), (9, 9), (10, 9)}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(250)] + [(5000, 5000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == components_of({x for e in real for x in e}, real)
    assert connected_components(df.limit(0)).count() == 0
