"""WARC archives by way of a chunked record table.

A payload is rows of (record, chunk number, bytes): no step but the scan holds a whole payload, and what is shuffled and
sorted are chunks. Digests are carried from chunk to chunk. A first pass over the chunks gives each record's digest and
length; a grouped aggregation finds the first record of each payload; the second pass brings a record's chunks to its digest
and writes gzip members record by record, chunk by chunk. Reading gives chunk rows again, with the digest so far.

Null payloads are empty ones. Records with equal payloads: that with the smallest id is the response, later ones are
revisits; rows that repeat the smallest id are responses too. Payloads smaller than ``least`` bytes are all responses. A
null id is written as an empty one and never referred to, unless all records of the payload have none. An empty table
gives no records. Urls may be null, and line breaks in them are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, utf8
from .files import committed, opened

CHUNK = 256 * 1024
SCHEME = "urn:rwspark:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def chunk_table(pages: DataFrame, payload: str = "html", keep: tuple[str, ...] = (), id_col: str = "page_id", chunk: int = CHUNK) -> DataFrame:
    """record_id, ``keep``, chunk_no, last, chunk; rows of a record follow each other within a partition. An empty payload has one empty chunk."""
    whole = pages.select(F.col(id_col).cast("long").alias("record_id"), *keep, utf8(payload).alias("payload"))
    return cut(whole, keep, chunk)


def cut(whole: DataFrame, keep: tuple[str, ...], chunk: int = CHUNK) -> DataFrame:
    """As chunk_table, of rows with record_id, ``keep`` and payload in bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / F.lit(chunk))).cast("int")
    split = whole.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    return split.select("record_id", *keep, "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"))


def _base32(digest: "hashlib._Hash") -> str:
    return base64.b32encode(digest.digest()).decode()


def digests(chunks: DataFrame) -> DataFrame:
    """record_id, mark, payload_bytes and sha (hexadecimal SHA-1) of each record, from digests carried over its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            ids, marks, sizes, out = [], [], [], []
            for record, mark, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                sha.update(data)
                size += len(data)
                if last:
                    ids.append(record)
                    marks.append(mark)
                    sizes.append(size)
                    out.append(sha.hexdigest())
                    sha, size = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.string())], names=["record_id", "mark", "payload_bytes", "sha"])

    return chunks.select("record_id", "mark", "last", "chunk").mapInArrow(run, "record_id long, mark long, payload_bytes long, sha string")


def planned(sums: DataFrame, least: int = 0) -> DataFrame:
    """A row for each record id and payload: mark, payload_bytes, sha, refers_to (null for a response).

    Equal payloads share digest and length. The first record of a payload is a minimum, combined before the shuffle; a
    payload that a third of the records share is joined back by salted keys, so no task gets all its records.
    """
    salts = 64
    key = ["sha", "payload_bytes"]
    first = sums.filter(F.col("payload_bytes") >= least).groupBy(*key).agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    # Single payloads have nobody to refer to; others are dealt over all salts.
    first = first.filter("n > 1").select(*key, "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = sums.dropDuplicates(["record_id", "mark", *key]).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")).join(first, [*key, "salt"], "left")
    return found.select("record_id", "mark", *key, F.when(F.col("record_id").isNull() | (F.col("record_id") != F.col("first")), F.col("first")).alias("refers_to"))


def _heads(record: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """The record's head and the HTTP head that opens its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{SCHEME}{'' if record is None else record}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{SCHEME}{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return "\r\n".join([*lines, "", ""]).encode(), http


def write(pages: DataFrame, folder: str, least: int = 0, payload: str = "html", id_col: str = "page_id", chunk: int = CHUNK) -> list[str]:
    """Write a record per row; the archives' paths."""
    from .common import written

    # Rows that share an id may differ in payload: a hash marks which is which, and goes with the chunks.
    whole = pages.select(F.col(id_col).cast("long").alias("record_id"), "url", utf8(payload).alias("payload"))
    whole = whole.withColumn("mark", F.xxhash64("payload", F.length("payload"))).withColumn("row", F.monotonically_increasing_id())
    plan = written(planned(digests(cut(whole.drop("url", "row"), ("mark",), chunk)), least), "warc-plan")
    plan = plan.select(F.col("record_id").alias("planned_id"), F.col("mark").alias("planned_mark"), "payload_bytes", "sha", "refers_to")
    chunks = cut(whole, ("url", "mark", "row"), chunk)
    chunks = chunks.join(plan, chunks.record_id.eqNullSafe(F.col("planned_id")) & (chunks.mark == F.col("planned_mark")))
    # The chunks of a row come from one task and go to one task; there, one record follows another.
    chunks = chunks.sortWithinPartitions("row", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, gz = TaskContext.get().partitionId(), 0, None
        name = f"records-{part:06d}.warc.gz"
        with committed(folder, name) as out:
            for batch in batches:
                for record, url, size, sha, refers_to, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if gz is None:
                        gz, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                        out.write(gz.compress(b"".join(_heads(record, url, size, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to))))
                    if refers_to is None:
                        out.write(gz.compress(data))
                    if last:
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                        gz = None
        yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "records": pa.array([n], pa.int64())})

    files = chunks.select("record_id", "url", "payload_bytes", "sha", "refers_to", "last", "chunk").mapInArrow(run, "name string, records long").collect()  # a row for each archive
    return [f"{folder}/{x.name}" for x in sorted(files) if x.records]


class Inflated:
    """Bytes of the gzip members of a stream, a bounded piece at a time."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.buffer = stream, size, bytearray()
        self.gz, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            data = self.gz.unconsumed_tail or self.rest or self.stream.read(self.size)
            self.rest = b""
            if not data:
                return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            self.buffer += (got := self.gz.decompress(data, self.size))
            if self.gz.eof:
                self.rest = self.gz.unused_data
            if got:
                return True

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.more():
                if self.buffer:
                    raise ValueError("a record ends within its head")
                return b""
        line = bytes(self.buffer[: at + 2])
        del self.buffer[: at + 2]
        return line

    def take(self, n: int) -> bytes:
        """Up to n bytes, some at least."""
        if not self.buffer and not self.more():
            raise ValueError("a record ends within its block")
        data = bytes(self.buffer[:n])
        del self.buffer[:n]
        return data


def head(source: Inflated, first: bytes) -> dict[str, str]:
    fields = {"": first.decode("utf-8", "replace").strip()}
    while (line := source.line()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.lower()] = value.strip()
    return fields


def records(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record, url, type, refers_to, chunk number, last, chunk, bytes so far, digest so far) of an archive's payloads."""
    number = lambda field: int(n) if (n := field.strip("<>").removeprefix(SCHEME)) else None
    with opened(path) as stream:
        source = Inflated(stream, chunk)
        while line := source.line():
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"{path}: not a WARC record: {line[:40]!r}")
            about = head(source, line)
            block = int(about["content-length"])
            http_line = source.line()
            size = len(http_line)
            fields = {}
            while (line := source.line()) != b"\r\n":
                size += len(line)
                name, _, value = line.decode().partition(":")
                fields[name.lower()] = value.strip()
            left, sha, done, k = block - size - 2, hashlib.sha1(), 0, 0
            kind = about["warc-type"]
            same = (number(about["warc-record-id"]), about.get("warc-target-uri"), kind, number(about["warc-refers-to"]) if kind == "revisit" else None)
            if kind == "revisit":
                yield (*same, 0, True, b"", int(fields["content-length"]), about["warc-payload-digest"].removeprefix("sha1:"))
            else:
                while True:
                    data = source.take(min(left, chunk)) if left else b""
                    left -= len(data)
                    sha.update(data)
                    done += len(data)
                    yield (*same, k, not left, data, done, _base32(sha))
                    k += 1
                    if not left:
                        break
                if _base32(sha) != about["warc-payload-digest"].removeprefix("sha1:") or done != int(fields["content-length"]):
                    raise ValueError(f"{path}: record {same[0]} is damaged")
            if source.line() + source.line() != b"\r\n\r\n":
                raise ValueError(f"{path}: record {same[0]} has no end")


FIELDS = "record_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, chunk binary, bytes_so_far long, digest_so_far string"


def read_chunks(spark: SparkSession, paths: list[str], payloads: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of archives, a task for each; without payloads, the last row of each record only and no bytes. Batches hold at most 16 MB or so of payload."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = spark.createDataFrame([], FIELDS)
    if not paths:
        return empty
    target = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in records(paths[k], chunk):
                    if payloads or row[5]:
                        rows.append(row if payloads else (*row[:6], None, *row[7:]))
                        held += len(row[6]) if payloads else 0
                    if len(rows) == 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives written to the shared folder and read again: a row per record."""
    spark = pages.sparkSession
    read = read_chunks(spark, write(pages, new_path(spark, "warc"), least), payloads=False)
    return read.select("record_id", "url", "record_type", "refers_to", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"))
