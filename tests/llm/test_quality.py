"""Held-out accuracy and defined cases of the classifier."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievewright.llm import quality as Q
from sievewright.llm.queries import op4_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.97
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def votes(model, texts, ids):
    """The vote by plain loops."""
    out = []
    for i, z in zip(ids, model.latent(Q.features(texts)), strict=True):
        cosine = {k: float(z @ v) for k, v in enumerate(model.vectors) if model.own.get(i) != k}
        least = sorted(cosine.values(), reverse=True)[: Q.NEIGHBOURS][-1]
        near = {k: np.exp(Q.SHARPNESS * (c - 1)) for k, c in cosine.items() if c >= least and c > 0}
        out.append(sum(w * model.labels[k] for k, w in near.items()) / sum(near.values()) if near else model.prior)
    return out


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels)
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], votes(model, [r.text for r in rows], [r.doc_id for r in rows]), strict=True))
    got = {r.doc_id: r.score for r in op4_quality(spark, sf).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 2e-3
    known = {r.doc_id for r in labels.filter("quality in (0, 1)").collect()}
    assert set(model.own) <= known and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in model.own)


def test_own_labels_do_not_count(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    labels = docs.select("doc_id", (F.xxhash64("doc_id", F.lit(77)) % 2 == 0).cast("int").alias("quality"))
    model = Q.fit(docs, labels)
    rows = Q.classify(docs, model).join(labels, "doc_id").filter("not held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert len(rows) > 500 and 0.44 < auc < 0.56


def test_vocabulary_is_seen(spark):
    """Texts of one shape whose words alone tell them apart."""
    rng = random.Random(2)
    words = {y: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)] for y in (0, 1)}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    found = Q.classify(docs, Q.fit(docs, labels)).filter("held_out").collect()
    assert len(found) > 50 and all(r.predicted == r.doc_id % 2 for r in found)


def test_cases(spark):
    texts = [None, "", " ", "word " * 100_000, "É\U0001f600", "UP!! UP!!", "same", "same"]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, `odd name` string")
    labels = spark.createDataFrame([(i, q) for i, q in [(0, 1), (1, None), (3, 0), (3, 1), (4, 7), (None, 1), (6, 1)]], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    rows = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    assert len(rows) == len(texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert rows[0].score == rows[1].score and rows[6].score == rows[7].score
    assert [r.held_out for _, r in sorted(rows.items())] == [r[0] for r in docs.orderBy("doc_id").select(F.expr("crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0")).collect()]


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    assert [r.score for r in Q.classify(docs, model).collect()] == [0.5]
    assert Q.classify(docs.limit(0), model).count() == 0
