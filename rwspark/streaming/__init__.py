"""Read/write policies over a stream of source words: a stateful operator for each sentence, with a batch twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id long, commit int, at int, exhausted boolean"
STATE = "read int, commits int, last int, waiting array<struct<i: int, fires: boolean>>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; where it is unset a local one on a local master (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or "file://" + tempfile.mkdtemp(prefix="rwspark-")).rstrip("/")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Words in their order: a commit where the policy fires, a last one at the end of the source. Words that come early wait."""
    read, commits, last, waiting = state.get if state.exists else (0, 0, 0, [])
    held = {w[0]: w[1] for w in waiting}
    n = 0
    for frame in frames:
        held.update(zip(frame["i"].tolist(), frame["fires"].tolist()))
        n = int(frame["n"].iloc[0])
    out = []
    while read + 1 in held:
        read += 1
        fires = bool(held.pop(read))
        if fires or read == n:
            commits += 1
            out.append((key[0], read, commits, not fires and last == 0))
            last = read if fires else last
    if n and read == n:
        state.remove()
    else:
        state.update((read, commits, last, sorted(held.items())))
    yield pd.DataFrame(out, columns=["id", "commit", "at", "exhausted"])


def commits(reads: DataFrame) -> DataFrame:
    """Commits of a stream of reads (id, n, i, fires). A sentence's state is dropped with its last word."""
    return reads.select("id", "n", "i", "fires").groupBy("id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(reads: DataFrame, files: int = 4) -> DataFrame:
    """``reads`` written in the order of words, streamed file by file through ``commits``, and the sink read again."""
    spark, base = reads.sparkSession, f"{shared_dir(reads.sparkSession)}/rwspark-stream-{uuid.uuid4().hex}"
    columns = reads.select("id", "n", "i", "fires")
    columns.repartitionByRange(files, "i").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sink = commits(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")


def activity(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """An extension, since the data model has no clock: counts by type in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def append_increment(source: str, target: str, spark: SparkSession, schema, transform=lambda df: df) -> None:
    """Annotate what has arrived since the last call: a checkpointed file stream, each file once."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target.rstrip('/')}-checkpoint").trigger(availableNow=True).start().awaitTermination()
