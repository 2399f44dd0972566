"""The committing sink and the batch loader."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sievewright.sources import committed as K
from sievewright.sources import io


def rows(spark, path):
    return sorted((r.id, r.text) for r in K.read_committed(spark, path, "id long, text string").collect())


def test_failed_jobs_leave_no_rows(spark, tmp_path):
    K.register(spark)
    path = f"{tmp_path}/sink"
    df = spark.range(40).repartition(4).select("id", F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"))
    broken = df.withColumn("text", F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken row"):
        broken.write.format("committed").option("path", path).mode("append").save()
    assert not glob.glob(f"{path}/job-*") and not glob.glob(f"{path}/_staged/*/*")
    df.write.format("committed").option("path", path).mode("append").save()
    want = [(i, f"é {i}") for i in range(40)]
    assert rows(spark, path) == want and not glob.glob(f"{path}/_staged/*/*")
    df.filter("id < 3").write.format("committed").option("path", path).mode("append").save()
    assert len(rows(spark, path)) == 43
    df.write.format("committed").option("path", path).mode("overwrite").save()
    assert rows(spark, path) == want
    with pytest.raises(Exception, match="path is missing"):
        df.write.format("committed").mode("append").save()


def test_retries():
    tries, pauses = [], []

    def act():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("busy")
        return "done"

    assert K.retried(act, 5, pauses.append) == "done" and pauses == [1, 2, 4]
    with pytest.raises(OSError):
        K.retried(lambda: (_ for _ in ()).throw(OSError("busy")), 2, pauses.append)
    with pytest.raises(KeyError):  # no fault of the target
        K.retried(lambda: {}["x"], 5, pauses.append)


def test_stream_batches_are_published_once(spark, tmp_path):
    K.register(spark)
    source, path = f"{tmp_path}/in", f"{tmp_path}/sink"
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).select("id", F.lit("x").alias("text")).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("id long, text string").json(source)
        stream.writeStream.format("committed").option("path", path).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
        assert rows(spark, path) == [(i, "x") for i in range(10 * (part + 1))]
    # a batch that runs again replaces its folder
    K.Folder(path).stage("again", "part-new.jsonl", b'{"id": 99, "text": "y"}\n')
    K.Folder(path).publish([K.Staged("again", "part-new.jsonl", 1)], "batch-1")
    assert rows(spark, path) == [*[(i, "x") for i in range(10)], (99, "y")]


@pytest.mark.parametrize("kind", ["parquet", "jsonl"])
def test_batches(spark, tmp_path, kind):
    path = f"{tmp_path}/t.{kind}"
    df = spark.createDataFrame([(i, f"t{i}", None) for i in range(103)], "id long, text string, more string")
    io.write_table(df.coalesce(1).sortWithinPartitions("id"), path)
    io.write_table(df.filter("id < 7").selectExpr("id + 1000 as id", "text", "more").coalesce(1).sortWithinPartitions("id"), path, "append")
    own = io.read_batches(spark, path, 10, ["id", "text"])
    got = sorted(tuple(r) for r in own.collect())
    assert sorted(p for *_, p, _ in got) == list(range(110)) and all(b == p // 10 for *_, p, b in got)
    files = [[r[0] for r in got if r[0] < 1000], [r[0] for r in got if r[0] >= 1000]]
    for ids in files:  # rows of a file stay together and in order
        places = [p for i, _, p, _ in got if i in set(ids)]
        assert places == list(range(min(places), min(places) + len(ids)))
    sizes = io.map_batches(own, lambda pdf: pdf.groupby("batch", as_index=False).agg(n=("id", "size"), first=("position", "min")), "batch long, n long, first long").orderBy("batch").collect()
    assert [(r.n, r.first) for r in sizes] == [(10, 10 * k) for k in range(11)]
    if kind == "parquet":
        scan = own._jdf.queryExecution().executedPlan().toString()
        assert "more" not in scan.split("ReadSchema: ")[1].split("\n")[0]
    with pytest.raises(ValueError):
        io.read_batches(spark, path, 0)
    assert os.path.isdir(path)
