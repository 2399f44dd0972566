"""Streams over append-only checkpoint files: the latest record of every key, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import keep_latest
from ..session import remove
from ..sources.io import exists


def record_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def keep_latest_table(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str, once: bool = True):
    """A table at ``path/batch=N`` with the latest record of each key; every batch merges with the one before.

    A batch that runs again writes the same folder anew, so its result is there once; the folder before the last one is
    deleted, as no batch reads it any more. The whole state is written with each batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch
        if number:
            both = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        keep_latest(both, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:
            remove(spark, f"{path}/batch={number - 2}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the finished tables ``path/name=N``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName().partition("=") for x in (files.listStatus(folder) if files.exists(folder) else [])]
    return sorted(int(n) for kind, _, n in found if kind == name and exists(spark, f"{path}/{name}={n}/_SUCCESS"))


def read_latest(spark: SparkSession, path: str, schema: str | StructType, key: str, order: list[str], upto: int | None = None) -> DataFrame:
    """The latest record of each key of a table that ``keep_changes_table`` writes, up to a batch."""
    states = [n for n in _numbers(spark, path, "state") if upto is None or n <= upto]
    state = states[-1] if states else -1
    changes = [n for n in _numbers(spark, path, "batch") if n > state and (upto is None or n <= upto)]
    folders = [f"{path}/batch={n}" for n in changes] + ([f"{path}/state={state}"] if states else [])
    every = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return keep_latest(every, key, order)


def keep_changes_table(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str, once: bool = True, merge_every: int = 50):
    """As ``keep_latest_table``, but a batch writes the keys that it has, at ``path/batch=N``; ``read_latest`` reads the table.

    Every ``merge_every`` batches the state is written as a whole at ``path/state=N``, and what it holds is deleted, so that a reader's work stays
    bounded. A batch that runs again writes the same folders; a state that is finished is not merged again.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keep_latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number and number % merge_every == 0:
            if number not in _numbers(spark, path, "state"):
                read_latest(spark, path, schema, key, order, number).write.mode("overwrite").parquet(f"{path}/state={number}")
            for kind, last in (("batch", number), ("state", number - 1)):
                for n in _numbers(spark, path, kind):
                    if n <= last:
                        remove(spark, f"{path}/{kind}={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, by: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each tumbling window and group; works on streams, where rows later than ``late`` are dropped."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
