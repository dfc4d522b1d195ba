"""One text file from many tasks: each writes a part of its own, and the commit joins the parts in the order of the partitions.

Rows keep the order of the frame. The parts lie in a folder beside the file until all tasks have ended; the commit streams them
through a bounded buffer to a new file there, which takes the place of ``path`` in one move. So there is never half a file:
what a lost or repeated task wrote is left out, and a job that fails removes its folder.

Writes that fail with OSError are tried again, after 1, 2, 4, ... times ``wait`` seconds. Where the place stays out of order, the
whole file goes to ``fallback``, under its own name, and ``resolved`` tells a reader which of the two there is.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

T = TypeVar("T")
CHUNK = 8 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def patient(action: Callable[[], T], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The action's result; OSError is met with another try, after waits that double, and raised after the last."""
    for k in range(tries):
        try:
            return action()
        except OSError:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("no tries")


def there(path: str) -> bool:
    store, at = filesystem(path)
    try:
        return store.get_file_info(at).type == fs.FileType.File
    except NotADirectoryError:
        return False


def aside(path: str, fallback: str) -> str:
    return f"{fallback.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}"


def resolved(path: str, fallback: str) -> str:
    """The path of a written file: its own, else that in the fallback folder; FileNotFoundError where there is neither."""
    for place in (path, aside(path, fallback)):
        if there(place):
            return place
    raise FileNotFoundError(f"neither {path} nor {aside(path, fallback)}")


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.fallback = options["path"], options.get("fallback")
        self.tries, self.wait = int(options.get("tries", 5)), float(options.get("wait", 1))
        self.before, self.between, self.after = (options.get(k, d) for k, d in (("before", ""), ("between", "\n"), ("after", "\n")))
        self.scratch = f"{options.get('scratch') or self.path.rstrip('/').rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, rows = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0
        store, base = filesystem(self.scratch)
        patient(lambda: store.create_dir(base, recursive=True), self.tries, self.wait)
        with patient(lambda: store.open_output_stream(f"{base}/{name}", compression=None), self.tries, self.wait) as out:
            for batch in batches:
                values = ["" if x is None else x for x in batch.column(0).to_pylist()]
                if values:
                    out.write(((self.between if rows else "") + self.between.join(values)).encode())
                    rows += len(values)
        return Part(task.partitionId(), name, rows)

    def joined(self, parts: list[Part], path: str) -> None:
        store, base = filesystem(self.scratch)
        goal, at = filesystem(path)
        goal.create_dir(at.rsplit("/", 1)[0] or "/", recursive=True)
        own = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        try:
            with goal.open_output_stream(own, compression=None) as out:
                out.write(self.before.encode())
                for k, part in enumerate(parts):
                    out.write(self.between.encode() if k else b"")
                    with store.open_input_stream(f"{base}/{part.name}", compression=None) as data:
                        while piece := data.read(CHUNK):
                            out.write(piece)
                out.write(self.after.encode() if parts or self.before else b"")
            goal.move(own, at)
        except OSError:
            if goal.get_file_info(own).type == fs.FileType.File:
                goal.delete_file(own)
            raise

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        try:
            try:
                patient(lambda: self.joined(parts, self.path), self.tries, self.wait)
            except OSError:
                if not self.fallback:
                    raise
                self.joined(parts, aside(self.path, self.fallback))
        finally:
            self.swept()

    def abort(self, messages: list[Part | None]) -> None:
        self.swept()

    def swept(self) -> None:
        store, base = filesystem(self.scratch)
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)


class OrderedText(DataSource):
    """``format("ordered_text")``: the one column of a frame, a row a line; other ``before``, ``between`` and ``after`` make other documents."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("ordered_text takes one column of strings")
        if not overwrite and there(self.options["path"]):
            raise FileExistsError(self.options["path"])
        return Writer(dict(self.options))


def write(df: DataFrame, path: str, fallback: str | None = None, scratch: str | None = None, **options: object) -> None:
    """``df``, one column of strings in its order, as one file; nulls are empty lines. Parts wait in ``scratch``, beside the file if not given."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(OrderedText)
    named = {k: str(v) for k, v in {"fallback": fallback, "scratch": scratch, **options}.items() if v is not None}
    df.write.format("ordered_text").mode("overwrite").options(**named).save(path)


def write_json_array(df: DataFrame, path: str, **options: object) -> None:
    """One JSON document with all rows, in the order of the frame."""
    write(df.select(F.to_json(F.struct("*")).alias("value")), path, before="[", between=",\n", after="]\n", **options)
