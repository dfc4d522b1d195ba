"""Importance resampling towards a target distribution of hashed n-grams, by external sort and count.

A map task hashes each document's features to buckets and writes them as packed streams of unsigned 16-bit numbers, a block
of documents a row, with the offset at which each document ends. Counts come from the blocks: sort, then run lengths, one block at a time,
added up by bucket over all tasks. Log ratios of the two smoothed distributions are the buckets' gains; a second pass over
the same streams gathers them and sums them by document. Documents are drawn by weight plus Gumbel noise, which is drawing
without replacement in proportion to exp(weight).

Texts are read once. Only counts (a row for each bucket and task at most) and drawn documents are shuffled. Ranks come from a
histogram of scores: a score has a task of its own, and no task sees all documents. The gains travel with the tasks: their
number is ``buckets``, 65,536 at most.

Null and empty texts have no features and weight 0. Repeated rows each count, and each is judged on its own. A null id is the
empty string in the noise, and comes first in ties. Texts of any length are one document of one block. An empty table, of
documents or target, counts nothing, and an empty document table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, utf8, written
from .decontam import words

BLOCK = 1 << 20


class Buckets:
    """Bucket of a feature; those of words are kept, up to a number."""

    def __init__(self, buckets: int, most: int = 500_000):
        self.buckets, self.most, self.known = buckets, most, {}

    def of(self, features: list[bytes]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.buckets
        return [known[f] for f in features]


def features(text: bytes, sizes: tuple[int, int]) -> tuple[int, list[bytes]]:
    """Number of words; all runs of so many words, by size and place."""
    w = words(text)
    low, high = sizes
    return len(w), [f for n in range(low, high + 1) for f in (w if n == 1 else [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)])]


def streams(docs: DataFrame, sizes: tuple[int, int] = (1, 1), buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Written blocks: ids, words and ends (places in the stream, which are the next document's offset) of the block's documents, and their packed buckets."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")
    if not 1 <= sizes[0] <= sizes[1]:
        raise ValueError("sizes of n-grams: the least, then the greatest")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, n_words, ends, packed = Buckets(buckets), [], [], [], []

        def row(id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([ids], pa.list_(id_type)), pa.array([n_words], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(packed)])]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "n_words", "ends", "stream"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = features(text.as_py(), sizes)
                ids.append(doc_id)
                n_words.append(n)
                ends.append((ends[-1] if ends else 0) + len(found))
                packed.append(np.array(numbers.of(found), "<u2").tobytes())
                if ends[-1] >= block or len(ids) >= block // 16:
                    yield row(batch.schema.field(0).type)
                    ids, n_words, ends, packed = [], [], [], []
        if ids:
            yield row(batch.schema.field(0).type)

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"ids array<{kind}>, n_words array<bigint>, ends array<bigint>, stream binary"), "streams")


def counts(blocks: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket and its number of features ``n``: sorted blocks, run lengths, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=-1) if len(ordered) else ordered)
                total[ordered[starts]] += np.diff(starts, append=len(ordered))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: 1000 times the log ratio of target and source, each count plus one; from their ``counts``."""
    spark = source.sparkSession
    total = lambda frame: frame.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = ((F.coalesce(F.col(c), F.lit(0)) + 1).cast("double") for c in "st")
    ratio = t * F.lit(total(source) + buckets) / (s * F.lit(total(target) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(blocks: DataFrame, gain: np.ndarray, id_type: str = "bigint") -> DataFrame:
    """id, n_words, n_features and weight (the floored mean of the gains) of each document, gathered from the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_words, ends = (batch.column(c)[k].values for c in range(3))
                ends = ends.to_numpy()
                size = np.diff(ends, prepend=0)
                some, sums = size > 0, np.zeros(len(size), np.int64)
                if some.any():  # reduceat has no empty segments
                    sums[some] = np.add.reduceat(gain[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")], (ends - size)[some])
                columns = [ids, n_words, pa.array(size), pa.array(sums // np.maximum(size, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def noisy(found: DataFrame, seed: int = 2024) -> DataFrame:
    """With ``score``: the weight plus Gumbel noise from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))))


def ranked(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """With ``rank`` 1, 2, 3, ... of the ``percent`` of documents of at least ``least_words`` with the highest scores; ties go to smaller ids; null for the rest. ``scored`` is read more than once."""
    able = scored.filter(F.col("n_words") >= least_words)
    n = F.sum("n")
    bars = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("score") / 1000))
    steps = bars.groupBy("step").agg(n.alias("of_step")).withColumn("above", F.sum("of_step").over(Window.orderBy(F.desc("step"))) - F.col("of_step"))  # some ten rows: scores are logarithms
    bars = bars.join(F.broadcast(steps), "step").select("score", (F.col("above") + n.over(Window.partitionBy("step").orderBy(F.desc("score"))) - F.col("n")).alias("before"))
    wanted = able.count() * percent // 100
    cut = bars.filter(F.col("before") < wanted).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.withColumn("rank", none)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id"))
    top = scored.filter(high).join(bars, "score").withColumn("rank", F.when(rank <= wanted, rank)).select(*scored.columns, "rank")
    return scored.filter(~high).withColumn("rank", none).unionByName(top)


def resampled(docs: DataFrame, target: DataFrame, sizes: tuple[int, int] = (1, 1), buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score and rank of each document; ``target`` has a column ``text``."""
    blocks = streams(docs, sizes, buckets, id_col, text_col)
    aim = counts(streams(target.select(F.lit(0).cast("long").alias("id"), F.col("text")), sizes, buckets, "id", "text"), buckets)
    found = written(counts(blocks, buckets), "counts")
    gain = np.array([r.gain for r in gains(found, aim, buckets).orderBy("bucket").collect()], np.int64)  # buckets: a fixed number
    return ranked(written(noisy(weights(blocks, gain, dict(docs.dtypes)[id_col]), seed), "weights"), percent, least_words)
