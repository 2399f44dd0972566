"""Rewrite chains: resuming by depth, retries, checks, and usage."""

import os
import time

import pytest

from sievewright.streaming import chain as C

SAMPLES = [("a", "one", "q1"), ("b", "two", "q2"), ("c", None, None)]


def loader(log, failing=()):
    """A client that notes each call in a file and fails as often as ``failing`` says, by kind and text of the prompt."""

    def load():
        def ask(prompt, kind, request):
            with open(log, "a") as f:
                f.write(f"{kind}|{prompt}|{request}\n")
            seen = sum(line.split("|")[:2] == [kind, prompt] for line in open(log))
            if seen <= dict(failing).get((kind, prompt), 0):
                raise ConnectionError("busy")
            return {"text": "5" if kind == "quality_check" else prompt + "!", "input_tokens": len(prompt), "output_tokens": len(prompt) + 1}

        return ask

    return load


def config(log, depths=3, checked=2, failing=(), **more):
    return C.ChainConfig(loader(log, failing), depths, lambda fields, text: text, lambda text: f"check {text}", checked, model=os.path.basename(log), **more)


def lines(log):
    return [x.strip().split("|") for x in open(log)] if os.path.exists(log) else []


def test_batch_resumes_at_the_first_missing_depth(spark, tmp_path):
    df = spark.createDataFrame(SAMPLES, "sample_id string, text string, prompt string")
    log = f"{tmp_path}/calls-batch"
    first = C.run_batch(df, config(log, depths=2, checked=None))
    first.write.parquet(f"{tmp_path}/log")
    assert len(lines(log)) == 6
    done = spark.read.parquet(f"{tmp_path}/log").filter("not (sample_id = 'b' and depth = 2)")
    again = C.run_batch(df, config(log), done)
    again.write.parquet(f"{tmp_path}/more")
    rows = spark.read.parquet(f"{tmp_path}/more").collect()
    assert sorted((r.sample_id, r.call_type, r.depth) for r in rows) == [
        ("a", "quality_check", 2), ("a", "rewrite", 3), ("b", "quality_check", 2), ("b", "rewrite", 2), ("b", "rewrite", 3), ("c", "quality_check", 2), ("c", "rewrite", 3),
    ]
    assert {(r.sample_id, r.depth): r.text for r in rows if r.call_type == "rewrite"} == {("a", 3): "one!!!", ("b", 2): "two!!", ("b", 3): "two!!!", ("c", 3): "!!!"}
    every = spark.read.parquet(f"{tmp_path}/log").filter("not (sample_id = 'b' and depth = 2)").unionByName(spark.read.parquet(f"{tmp_path}/more"))
    assert C.run_batch(df, config(log), every).count() == 0
    usage = {r.depth: r for r in C.usage_of(every).collect()}
    assert [usage[d].requests for d in (1, 2, 3)] == [3, 6, 3] and [usage[d].rewrite_requests for d in (1, 2, 3)] == [3, 3, 3]
    assert usage[3].cumulative_rewrite_input_tokens == sum(len(t or "") + d for _, t, _ in SAMPLES for d in range(3))


def test_pauses():
    assert [C.pause(k) for k in (1, 2, 3, 5, 6, 9)] == [1, 2, 4, 16, 30, 30]


def wait(query, spark, path, n, most=90):
    """Until ``n`` calls are in the table, or the query ended."""
    began = time.time()
    while time.time() - began < most:
        if query.exception():
            raise query.exception()
        if os.path.exists(f"{path}/_spark_metadata") and spark.read.schema(C.CALL).parquet(path).count() >= n:
            return
        time.sleep(0.5)
    raise AssertionError("too slow")


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    log, out, ck, source = (f"{tmp_path}/{x}" for x in ("calls-stream", "out", "ck", "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        schema = "sample_id string, text string, prompt string"
        spark.createDataFrame(SAMPLES, schema).coalesce(1).write.json(source)
        own = config(log, failing=((("rewrite", "two!"), 1),))

        def start(every):
            stream = spark.readStream.schema(schema).json(source)
            return C.run_stream(stream, own).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(processingTime=every).start()

        query = start("10 seconds")
        wait(query, spark, out, 3)
        began = time.time()
        while query.status["isTriggerActive"] and time.time() - began < 40:  # it is stopped between two batches: no call is under way
            time.sleep(0.01)
        query.stop()
        before = spark.read.schema(C.CALL).parquet(out).count()
        spark.createDataFrame([("a", "changed", "q"), ("d", "new", "q")], schema).coalesce(1).write.mode("append").json(source)
        query = start("500 milliseconds")
        wait(query, spark, out, 16)
        query.stop()
        rows = spark.read.schema(C.CALL).parquet(out).collect()
        assert before < 16 == len(rows)
        assert sorted((r.sample_id, r.call_type, r.depth) for r in rows) == sorted((s, k, d) for s in "abcd" for k, d in (("rewrite", 1), ("rewrite", 2), ("rewrite", 3), ("quality_check", 2)))
        assert {r.sample_id: r.text for r in rows if r.depth == 3} == {"a": "one!!!", "b": "two!!!", "c": "!!!", "d": "new!!!"}
        asked = [x[2] for x in lines(log)]
        assert len(asked) == 17 and len(set(asked)) == 16  # one failed and was asked again
        assert {(r.sample_id, r.depth): r.attempts for r in rows if r.attempts > 1} == {("b", 2): 2}
        usage = {r.depth: r for r in C.usage_of(spark.createDataFrame(rows, C.CALL)).collect()}
        assert [usage[d].requests for d in (1, 2, 3)] == [4, 8, 4] and usage[2].quality_requests == 4
        assert usage[3].cumulative_total_tokens == sum(r.total_tokens for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_failures_end_a_sample(spark, tmp_path):
    df = spark.createDataFrame(SAMPLES[:1], "sample_id string, text string, prompt string")
    with pytest.raises(Exception, match="busy"):
        C.run_batch(df, config(f"{tmp_path}/calls-fail", failing=((("rewrite", "one"), 9),), retries=1)).collect()
    with pytest.raises(Exception, match="empty answer"):
        C.run_batch(df, C.ChainConfig(lambda: lambda *_: {"text": ""}, 1, lambda f, t: t, model="empty", retries=1)).collect()
    assert C.run_batch(df.limit(0), config(f"{tmp_path}/calls-none")).count() == 0
