"""Readers and writers chosen by suffix, manifests, bundles and shard folders. Paths go through Hadoop's file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_list, normalize_space
from ..operators.quality import require_columns
from ..operators.ranges import numbered

SUFFIXES = ["parquet", "csv", "jsonl", "json"]
WIDE = ["hc3_row_id", "source", "question", "human_answers", "chatgpt_answers"]


def suffix(path: str) -> str:
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in SUFFIXES:
        raise ValueError(f"unsupported file type: {path}")
    return kind


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, CSV with multi-line cells, JSON lines or JSON; only the named columns are scanned."""
    kind = suffix(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    else:
        df = spark.read.options(multiLine=kind == "json", mode="FAILFAST").json(path)
    if columns:
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Written by Spark's commit protocol: a reader sees the old table or the new one."""
    kind, w = suffix(path), df.write.mode(mode)
    if kind == "parquet":
        w.parquet(path)
    elif kind == "csv":
        listed = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*listed).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
    else:
        w.json(path)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a table; of parquet from the footers alone."""
    return read_table(spark, path).count()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_split(spark: SparkSession, folder: str, split: str, explicit: str | None = None) -> str:
    """The split's file: an explicit path, which must exist, else the first known suffix that does."""
    for path in [explicit] if explicit else [f"{folder}/{split}.{s}" for s in SUFFIXES]:
        if exists(spark, path):
            return path
    raise FileNotFoundError(explicit or f"{folder}/{split}.*")


def read_wide(spark: SparkSession, path: str, variant: str = "rewrite", default_source: str | None = "unknown") -> DataFrame:
    """Question rows with their answer lists decoded; a blank source gets the default."""
    df = read_table(spark, path)
    require_columns(df, WIDE)
    lists = [(decode_list(F.col(c), variant) if df.schema[c].dataType.simpleString() == "string" else F.col(c)).alias(c) for c in WIDE[3:]]
    source = F.nullif(normalize_space(F.col("source")), F.lit(""))
    return df.select(F.col("hc3_row_id").cast("long").alias("hc3_row_id"), F.coalesce(source, F.lit(default_source or "")).alias("source"), F.trim("question").alias("question"), *lists)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text`` of the lines that are no JSON objects; lines count from 1 in each file, whose blocks are read whole for that."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return files.filter((F.trim("text") != "") & F.try_parse_json("text").isNull() | (F.trim("text") != "") & ~F.trim("text").startswith("{")).select("file", (F.col("line") + 1).alias("line"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, check: bool = False) -> DataFrame:
    """JSON lines; a broken line fails the read, with ``check`` by its file and line number before anything else is read."""
    if check and (bad := broken_lines(spark, path).limit(1).collect()):
        raise ValueError(f"{bad[0]['file']}:{bad[0]['line']}: no JSON object: {bad[0]['text'][:80]}")
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def ensure_folder(spark: SparkSession, path: str) -> str:
    p, fs = _folder(spark, path)
    fs.mkdirs(p)
    return path


def reset_folder(spark: SparkSession, path: str, preserve: list[str] | None = None) -> list[str]:
    """Empties a folder but for the names to preserve; returns the names that were deleted."""
    p, fs = _folder(spark, ensure_folder(spark, path))
    gone = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name not in (preserve or []):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(candidates))


def copy_first(spark: SparkSession, candidates: list[str], target: str) -> str:
    """``target`` if it exists, else a copy of the first candidate that does."""
    if not exists(spark, target):
        (a, fs), (b, out) = _folder(spark, first_existing(spark, candidates)), _folder(spark, target)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, out, b, False, spark._jsc.hadoopConfiguration())
    return target


def write_by_source(df: DataFrame, folder: str, source: str = "source") -> dict[str, int]:
    """All rows as ``unified_<rows>`` and those of each source under ``by_source/<column>=<value>``; returns the counts, which also go to the manifest."""
    counts = {str(r[0]): r["count"] for r in df.groupBy(source).count().orderBy(source).collect()}
    write_table(df, f"{folder}/unified_{sum(counts.values())}.parquet")
    df.write.mode("overwrite").partitionBy(source).parquet(f"{folder}/by_source")
    write_manifest(df.sparkSession, {"rows_by_source": counts}, f"{folder}/manifest")
    return counts


def read_small_text(spark: SparkSession, path: str) -> str:
    """A settings file as one text, hidden ones too."""
    p, fs = _folder(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_environment(spark: SparkSession, path: str) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments and lines without a sign are skipped, quotes around a value go. Nothing is set."""
    out = {}
    for line in read_small_text(spark, path).splitlines() if exists(spark, path) else []:
        name, sign, value = line.strip().partition("=")
        if sign and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out


def read_prefix(spark: SparkSession, path: str | None, default: str) -> str:
    """A prompt's opening from a file, the default if there is none or it is blank."""
    if path and exists(spark, path) and (text := read_small_text(spark, path).strip()):
        return text
    return default


def with_default_domain(df: DataFrame, split: str, domain: str = "domain") -> DataFrame:
    """Rows without a domain get the name of their split."""
    own = F.nullif(normalize_space(F.col(domain)), F.lit("")) if domain in df.columns else F.lit(None).cast("string")
    return df.withColumn(domain, F.coalesce(own, F.lit(split)))


def read_curve(spark: SparkSession, path: str, tab: bool = False) -> DataFrame:
    """A curve written by ``write_curve``; numbers that cannot be read are null."""
    df = spark.read.options(header=True, sep="\t" if tab else ",").csv(path)
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in ("fpr", "tpr", "threshold")])


def write_manifest(spark: SparkSession, content: dict, path: str) -> None:
    """One JSON file with sorted keys."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_bundle(df: DataFrame, folder: str, manifest: dict | None = None, split: str = "split") -> None:
    """All rows partitioned by split, and a manifest with the counts."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{folder}/data")
    counts = {str(r[0]): r["count"] for r in df.groupBy(split).count().collect()}
    write_manifest(df.sparkSession, (manifest or {}) | {"rows_by_split": counts}, f"{folder}/manifest")


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Tables of all shard folders that match, with ``shard`` from the folder's name and the file's path."""
    path = F.col("_metadata.file_path")
    df = spark.read.parquet(pattern)
    return df.select("*", path.alias("path")).withColumn("shard", F.nullif(F.regexp_extract("path", r"shard_(\d+)_of_\d+", 1), F.lit("")).cast("int"))


def write_curve(df: DataFrame, path: str, tab: bool = False) -> None:
    df.select("fpr", "tpr", "threshold").orderBy("fpr", "tpr").coalesce(1).write.mode("overwrite").options(header=True, sep="\t" if tab else ",").csv(path)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_batches(spark: SparkSession, path: str, batch: int, columns: list[str] | None = None) -> DataFrame:
    """Adds ``position`` (from 0, in the order of files and rows) and ``batch`` (so many rows each, the last may have fewer).

    Of parquet the scan itself tells a row's place in its file; sizes of files come from a scan of no columns, which footers answer, a row for each file. Other formats are
    numbered by ranges of Spark's own row order.
    """
    if batch <= 0:
        raise ValueError(f"a batch holds one row at least, not {batch}")
    df = read_table(spark, path, columns)
    names = df.columns
    if suffix(path) == "parquet":
        placed = df.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        sizes = read_table(spark, path).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_size"))
        before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        starts = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
        place = F.col("_start") + F.col("_row")
        numbered_rows = placed.join(starts, "_file")
    else:
        numbered_rows = numbered(df.withColumn("_row", F.monotonically_increasing_id()), [], [F.col("_row")], "_place")
        place = F.col("_place") - 1
    return numbered_rows.select(*names, place.cast("long").alias("position"), F.floor(place / batch).cast("long").alias("batch"))


def map_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of each batch of ``read_batches``, a pandas frame in the order of ``position``."""
    return df.groupBy("batch").applyInPandas(lambda pdf: make(pdf.sort_values("position", ignore_index=True)), schema)
