"""Budgets against a plain water-filling, prefixes against a sorted walk, and the DuckDB query."""

import hashlib
import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright.llm import mixing
from sievewright.llm.queries import OP10_SQL, op10_mixing


def fill(budget, children):
    """children: name -> (capacity, weight); bisection on the common factor."""
    budget = min(budget, sum(c for c, w in children.values() if w > 0))
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(c, mid * w) for c, w in children.values()) < budget:
            low = mid
        else:
            high = mid
    return {k: min(c, high * w) for k, (c, w) in children.items()}


@pytest.mark.parametrize("budget", [0.0, 10.0, 55.0, 99.0, 1000.0])
def test_share(spark, budget):
    rows = [("p", "a", 10.0, 5.0), ("p", "b", 50.0, 1.0), ("p", "c", 30.0, 2.0), ("p", "d", 7.0, 0.0), ("p", "e", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "parent string, child string, capacity double, weight double").withColumn("budget", F.lit(budget))
    got = {r.child: r.granted for r in mixing.share(df, ["parent"], "capacity", "weight", "budget").collect()}
    want = fill(budget, {r[1]: (r[2], r[3]) for r in rows})
    assert got == pytest.approx(want, abs=1e-6)


def test_prefixes(spark):
    docs = [(i, "x" * (i * 37 % 50), "s" + str(i % 3 and 1), "e") for i in range(300)] + [(None, None, None, None), (5, "dup", "s1", "e"), (5, "dup", "s1", "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, epochs string")
    rows = mixing.mix(df, ["source"], 0.9, max_epochs=2).collect()
    leaf = defaultdict(list)
    for i, text, source, _ in docs:
        leaf[source or ""].append((hashlib.md5(f"42|{'' if i is None else i}".encode()).hexdigest(), i if i is not None else -1, text or "", math.ceil(len(text or "") / 4)))
    total = sum(x[3] for v in leaf.values() for x in v)
    budgets = fill(math.floor(total * 0.9), {k: (2 * sum(x[3] for x in v), 1.0) for k, v in leaf.items()})
    want = defaultdict(int)
    for k, v in leaf.items():
        own = sum(x[3] for x in v)
        budget = math.floor(budgets[k] + 1e-6)
        whole, rest = (budget // own, budget % own) if own else (0, 0)
        upto = 0
        for _, i, text, n in sorted(v):
            upto += n
            if epochs := whole + (upto <= rest):
                want[i, text, epochs] += 1
    got = defaultdict(int)
    for r in rows:
        got[-1 if r.doc_id is None else r.doc_id, r.text or "", r.epochs] += 1
    assert got == want


def test_clashing_columns_and_a_very_long_text(spark, monkeypatch):
    names = ["level0", "fine", "coarse", "hash", "key", "row", "_bin", "_hash", "whole", "edge"]
    docs = [(i, "x" * (3_000_000 if i == 7 else 40 + i), "s" + str(i % 3), *[f"{n}{i}" for n in names]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    rows = {}
    for most in (20_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        rows[most] = sorted((tuple(r) for r in mixing.mix(df, ["source"], 1.0, max_epochs=1).collect()), key=str)
    assert rows[0] == rows[20_000] and len(rows[0]) == 60
    assert all(r[3 : 3 + len(names)] == tuple(f"{n}{r[0]}" for n in names) and r[-2] == math.ceil(len(r[1]) / 4) and r[-1] == 1 for r in rows[0])


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), ["source"], 0.5).count() == 0


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, domain, lang, source, tokens, epochs FROM ({OP10_SQL})").fetchall())
    got = sorted(tuple(r) for r in op10_mixing(spark, sf).select("doc_id", "domain", "lang", "source", "tokens", "epochs").collect())
    assert got == want and got
