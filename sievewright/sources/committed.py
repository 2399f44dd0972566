"""A sink that shows a job's rows once and as a whole: format ``committed``, for tables and for streams.

Every task stages its rows as one part of JSON lines under a name of its own attempt, trying again after 1, 2, 4 ... 30 seconds where the target fails, and hands
the name to the driver. Commit publishes the parts of the attempts that Spark took, abort removes what was staged; so failed attempts leave no rows, and a
part is there once. A stream's parts lie in a folder for each batch: a batch that runs again replaces its own.

Options: ``path``, a folder that all executors share (any file system of ``pyarrow.fs``), and ``retries``. ``register(spark)`` makes the format known.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

LONGEST = 30.0
PUBLISHED = "published"


@dataclass
class Staged(WriterCommitMessage):
    job: str
    name: str
    rows: int


def retried(act: Callable[[], Any], retries: int, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``act()``, tried ``retries`` times at most with growing pauses."""
    for attempt in range(1, retries + 1):
        try:
            return act()
        except OSError:
            if attempt == retries:
                raise
            sleep(min(LONGEST, 2.0 ** (attempt - 1)))
    raise ValueError("no attempt is allowed")


class Folder:
    """Parts in a folder: staged ones beside the published ones, moved by a rename."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}")

    def stage(self, job: str, name: str, data: bytes) -> None:
        self.files.create_dir(f"{self.root}/_staged/{job}", recursive=True)
        with self.files.open_output_stream(f"{self.root}/_staged/{job}/{name}") as f:
            f.write(data)

    def publish(self, staged: list[Staged], folder: str) -> None:
        """The folder holds these parts and no others from here on; a list of them is written last."""
        from pyarrow import fs

        target = f"{self.root}/{folder}"
        if self.files.get_file_info(target).type != fs.FileType.NotFound and f"{PUBLISHED}.json" in {x.base_name for x in self.files.get_file_info(fs.FileSelector(target))}:
            self.files.delete_dir(target)
        self.files.create_dir(target, recursive=True)
        for part in staged:
            self.files.move(f"{self.root}/_staged/{part.job}/{part.name}", f"{target}/{part.name}")
        with self.files.open_output_stream(f"{target}/{PUBLISHED}.json") as f:
            f.write(json.dumps(sorted(part.name for part in staged)).encode())

    def drop(self, job: str) -> None:
        from pyarrow import fs

        if self.files.get_file_info(f"{self.root}/_staged/{job}").type != fs.FileType.NotFound:
            self.files.delete_dir(f"{self.root}/_staged/{job}")

    def clear(self) -> None:
        """Removes all that is published."""
        from pyarrow import fs

        for x in self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True)):
            if x.type == fs.FileType.Directory and x.base_name != "_staged":
                self.files.delete_dir(x.path)


class _Writing:
    def __init__(self, options: dict[str, str], job: str):
        if "path" not in options:
            raise ValueError("the option path is missing")
        self.path, self.retries, self.job = options["path"], int(options.get("retries", 5)), job

    def staged(self, rows: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.jsonl" if context else f"part-{uuid.uuid4().hex}.jsonl"
        lines = [json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in rows]
        retried(lambda: Folder(self.path).stage(self.job, name, "".join(x + "\n" for x in lines).encode()), self.retries)
        return Staged(self.job, name, len(lines))

    def published(self, messages: list[WriterCommitMessage | None], folder: str) -> None:
        own = [m for m in messages if m is not None]
        Folder(self.path).publish([m for m in own if m.rows], folder)
        self.dropped(own)

    def dropped(self, messages: list[WriterCommitMessage | None]) -> None:
        for job in {self.job, *(m.job for m in messages if m is not None)}:
            Folder(self.path).drop(job)


class CommittedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.work, self.overwrite = _Writing(options, uuid.uuid4().hex), overwrite

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.work.staged(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            Folder(self.work.path).clear()
        self.work.published(messages, f"job-{self.work.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.work.dropped(messages)


class CommittedStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.work = _Writing(options, uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.work.staged(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self.work.published(messages, f"batch-{batchId}")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self.work.dropped(messages)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedStreamWriter:  # noqa: N802
        return CommittedStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The published rows: those of folders whose list is written."""
    return spark.read.schema(schema).option("pathGlobFilter", "part-*.jsonl").json(f"{path}/[jb]*-*")
