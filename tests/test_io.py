"""Readers, writers, models and streams."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators import models
from sievewright.sources import io
from sievewright.streaming import checkpoints as C


@pytest.mark.parametrize("kind", ["parquet", "csv", "jsonl", "json"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, None)], "id long, text string")
    path = f"{tmp_path}/t.{kind}"
    io.write_table(df, path)
    got = io.read_table(spark, path, ["id", "text"]) if kind != "json" else spark.read.json(path)
    assert sorted((int(r.id), r.text) for r in got.collect()) == [(1, 'two\nlines, "quoted"'), (2, None)]


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        io.read_table(spark, "x.xlsx")
    with pytest.raises(FileNotFoundError):
        io.resolve_split(spark, str(tmp_path), "train")
    io.write_table(spark.range(3), f"{tmp_path}/train.parquet")
    assert io.resolve_split(spark, str(tmp_path), "train").endswith("train.parquet") and io.count_rows(spark, f"{tmp_path}/train.parquet") == 3
    with pytest.raises(ValueError, match="missing columns: b"):
        io.read_table(spark, f"{tmp_path}/train.parquet", ["id", "b"])


def test_wide_and_bundle(spark, tmp_path):
    rows = [(5, " ", " q ", '["a", " "]', "['b','c']")]
    io.write_table(spark.createDataFrame(rows, "hc3_row_id long, source string, question string, human_answers string, chatgpt_answers string"), f"{tmp_path}/w.csv")
    (r,) = io.read_wide(spark, f"{tmp_path}/w.csv").collect()
    assert tuple(r) == (5, "unknown", "q", ["a"], ["b", "c"])
    io.write_bundle(spark.range(6).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("test")), f"{tmp_path}/b", {"seed": 1})
    assert io.read_manifest(spark, f"{tmp_path}/b/manifest") == {"rows_by_split": {"test": 2, "train": 4}, "seed": 1}


def test_shards(spark, tmp_path):
    for k in (1, 2):
        spark.range(k).write.parquet(f"{tmp_path}/shards/shard_0{k}_of_02/data")
    assert {(r.shard, r.n) for r in io.read_shards(spark, f"{tmp_path}/shards/shard_*/data").groupBy("shard").agg(F.count("*").alias("n")).collect()} == {(1, 1), (2, 2)}


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "k string, at long, v string"
    for n, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        C.keep_latest_table(C.record_stream(spark, f"{tmp_path}/in", schema), "k", ["at"], f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        got = {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect()}
        assert got == [{"a": "x", "b": "y"}, {"a": "z", "b": "y"}][n]


def test_changes_table(spark, tmp_path):
    schema = "k string, at int, v string"
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("a", 0, "old")], [("c", 1, "n")], [("b", 5, "w"), ("c", 0, "late")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        C.keep_changes_table(C.record_stream(spark, f"{tmp_path}/in", schema), "k", ["at"], f"{tmp_path}/out", f"{tmp_path}/ck", merge_every=2).awaitTermination(60)
        want = {}
        for r in sorted((r for b in batches[: n + 1] for r in b), key=lambda r: r[1]):
            want[r[0]] = r[2]
        assert {r.k: r.v for r in C.read_latest(spark, f"{tmp_path}/out", schema, "k", ["at"]).collect()} == want
    # the third batch was merged; the fourth holds its own keys only
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=3", "state=2"]
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/out/batch=3").collect()} == {"b", "c"}
    assert C.read_latest(spark, f"{tmp_path}/none", schema, "k", ["at"]).count() == 0


def test_scorer(spark):
    df = spark.createDataFrame([("a",), ("bbb",), (None,)], "text string")
    rows = models.score_texts(df, "text", lambda: lambda texts: [float(len(t)) for t in texts], batch=2).collect()
    assert {r.text: r.score for r in rows} == {"a": 1.0, "bbb": 3.0, None: 0.0}


def test_detectors_learn(spark):
    good, bad = "the quick brown fox jumps over lazy dogs today", "spam offer click win prize cash now free"
    rows = [(i, (good if i % 2 else bad) + f" w{i % 7}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    test = df.filter("doc_id >= 60")
    labels = {r[0]: r[2] for r in rows}
    for got in (models.predict_svm(test, *models.fit_svm(df.filter("doc_id < 40"), df.filter("doc_id >= 40 and doc_id < 60")), "doc_id"), models.predict_trees(test, models.fit_trees(df.filter("doc_id < 60"), config=models.TreeConfig(rounds=3)), "doc_id")):
        assert all((r.pred_label == "ai") == (labels[r.doc_id] == 1) for r in got.collect())
