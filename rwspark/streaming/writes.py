"""Reads and writes of a policy over a stream of source words: keyed state for each sentence, with timers for sentences that break off.

A sentence's state is how many words were read, its commits, and the words that came early. A commit writes the ids that came with
its word, up to the first that ends a write or to a cap. The last word ends the sentence and drops its state; where a sentence's
next words don't come within ``patience`` of event time, a timer writes what was read and drops it. The batch twin is
``replay.written_chunk`` over ``latency.drained``.

Repeated words count once. Words after a sentence's end (or its timer) begin it anew, as nothing of it is kept.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from rwspark.operators.replay import CAP, ENDS

from . import shared_dir

OUT = "id bigint, commit int, at int, exhausted boolean, ids array<int>, ended string, cap_hit boolean, timed_out boolean"
WRITTEN = Row(*(x.split()[0] for x in OUT.split(", ")))


def written(ids: list[int], cap: int, ends: dict[int, str]) -> tuple[list[int], str | None, bool]:
    """ids before the first that ends a write, by which it ended, and whether the cap did."""
    for k, x in enumerate(ids[:cap]):
        if x in ends:
            return ids[:k], ends[x], False
    return ids[:cap], None, len(ids) >= cap


class Sentence(StatefulProcessor):
    def __init__(self, cap: int = CAP, ends: dict[int, str] = ENDS, patience: int = 600_000):
        self.cap, self.ends, self.patience = cap, ends, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "read int, commits int, last int, ids array<int>, timer bigint")
        self.early = handle.getMapState("early", "i int", "fires boolean, ids array<int>")

    def written(self, key: tuple, read: int, at: int, exhausted: bool, ids: list[int], timed_out: bool) -> Row:
        return WRITTEN(key[0], read, at, exhausted, *written(list(ids or ()), self.cap, self.ends), timed_out)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        read, commits, last, held, timer = self.progress.get() if self.progress.exists() else (0, 0, 0, [], None)
        words, n, clock = {}, 0, timerValues.getCurrentWatermarkInMs()
        for row in rows:
            n, clock = row.n, max(clock, row.clock)
            if row.i > read:
                words[row.i] = (bool(row.fires), row.ids)
        waits = self.early.exists()
        while read < n:
            if read + 1 in words:
                fires, held = words.pop(read + 1)
            elif waits and self.early.containsKey((read + 1,)):
                fires, held = self.early.getValue((read + 1,))
                self.early.removeKey((read + 1,))
            else:
                break
            read += 1
            if fires or read == n:
                commits += 1
                yield self.written(key, read, commits, not fires and last == 0, held, False)
                last = read if fires else last
        if timer is not None:
            self.handle.deleteTimer(timer)
        if n and read == n:
            self.progress.clear()
            self.early.clear()
            return
        for i, word in words.items():
            self.early.updateValue((i,), word)
        timer = clock + self.patience
        self.handle.registerTimer(timer)
        self.progress.update((read, commits, last, list(held or ()), timer))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        read, commits, last, held, _ = self.progress.get()
        self.progress.clear()
        self.early.clear()
        yield self.written(key, read, commits + 1, last == 0, held, True)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for streams that start in here."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def writes(reads: DataFrame, late: str = "1 minute", **options: Any) -> DataFrame:
    """Commits and writes of a stream of reads: id, n, i, fires, ids (what a model writes if it commits there) and ts, when the word came. Options are those of ``Sentence``."""
    rows = reads.select("id", "n", "i", "fires", "ids", "ts", F.unix_millis("ts").alias("clock")).withWatermark("ts", late)
    return rows.groupBy("id").transformWithState(Sentence(**options), OUT, "append", "EventTime")


def in_turn(spark: SparkSession, folder: str) -> None:
    """Files get times of change in the order of their names, by which a stream takes them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for k, file in enumerate(found):
        store.setTimes(file, 1_700_000_000_000 + 1000 * k, -1)


def replayed(reads: DataFrame, files: int = 4, **options: Any) -> DataFrame:
    """``reads`` written in the order of ``ts``, streamed file by file through ``writes``, and the sink read again."""
    spark, base = reads.sparkSession, f"{shared_dir(reads.sparkSession)}/rwspark-stream-{uuid.uuid4().hex}"
    columns = reads.select("id", "n", "i", "fires", "ids", "ts")
    columns.repartitionByRange(files, "ts").write.parquet(f"{base}/in")
    in_turn(spark, f"{base}/in")
    stream = spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    with state_store(spark):
        sink = writes(stream, **options).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(OUT).parquet(f"{base}/out")
    out._checkpoint = f"{base}/checkpoint"
    return out


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped stream still holds: the state of sentences that have not ended."""
    with state_store(spark):
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "progress").load()


def arrival(i: str = "i", start: str = "2024-01-01") -> Column:
    """A clock for recorded sentences, a second a word."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col(i))
