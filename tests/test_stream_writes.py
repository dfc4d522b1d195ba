"""The stream with writes against its batch twin, and sentences that break off."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rwspark.operators import latency, replay
from rwspark.streaming import writes

READS = "id long, n int, i int, fires boolean, ids array<int>"


def sentences(seed, count):
    r = random.Random(seed)
    for k in range(count):
        n = r.randrange(1, 9)
        for i in range(1, n + 1):
            yield k, n, i, r.random() < 0.3, [r.choice([7, 8, 9, 1, 262145]) for _ in range(r.randrange(6))] if r.random() < 0.5 else [5] * r.randrange(3, 6)


def clocked(frame):
    return frame.withColumn("ts", writes.arrival())


def test_stream_is_its_batch_twin(spark):
    frame = spark.createDataFrame(list(sentences(1, 40)), READS)
    rows = latency.drained(frame.withColumn("m", F.lit(3)))
    twin = rows.join(frame.select("id", F.col("i").alias("commit"), "ids"), ["id", "commit"]).withColumn("w", replay.written_chunk(F.col("ids"), 4))
    want = twin.select("id", "commit", "at", "exhausted", "w.ids", "w.ended", "w.cap_hit", F.lit(False).alias("timed_out")).collect()
    got = writes.replayed(clocked(frame), 3, cap=4)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want)))
    assert writes.left_over(spark, got._checkpoint).count() == 0


def test_words_out_of_order_and_twice(spark):
    rows = [r for r in sentences(2, 25)]
    frame = spark.createDataFrame(rows, READS)
    shuffled = spark.createDataFrame([(*r, k) for k, r in enumerate(random.Random(3).sample(rows, len(rows)))], READS + ", o int").withColumn("ts", writes.arrival("o"))
    twice = shuffled.unionByName(shuffled.filter("o % 5 = 0 AND i < n"))
    want, got = (sorted(map(str, map(tuple, writes.replayed(x, 4, cap=4).collect()))) for x in (clocked(frame), twice))
    assert got == want


def test_sentences_that_break_off_are_ended(spark):
    """Sentence 1 never gets its last words: the clock of others ends it, and nothing is held at the end."""
    rows = [(1, 9, i, i == 2, [10 + i], i) for i in (1, 2, 3, 4, 6)] + [(2, 3, 1, False, [5], 1)]
    rows += [(3, 1, 1, False, [6], 4_000), (4, 1, 1, False, [7], 9_000), (5, 1, 1, False, [8], 12_000)]
    frame = spark.createDataFrame(rows, READS + ", o int").withColumn("ts", writes.arrival("o"))
    got = writes.replayed(frame, 4, patience=300_000)
    found = {r.id: [] for r in got.collect()}
    for r in got.orderBy("id", "at").collect():
        found[r.id].append((r.commit, r.at, r.exhausted, list(r.ids), r.timed_out))
    assert found[1] == [(2, 1, False, [12], False), (4, 2, False, [14], True)]
    assert found[2] == [(1, 1, True, [5], True)] and all(found[k] == [(1, 1, True, [k + 3], False)] for k in (3, 4, 5))
    assert writes.left_over(spark, got._checkpoint).count() == 0


def test_ends_of_writes():
    assert writes.written([3, 1, 4], 40, {1: "eos"}) == ([3], "eos", False)
    assert writes.written([3] * 50, 40, {1: "eos"}) == ([3] * 40, None, True) and writes.written([], 40, {}) == ([], None, False)
    assert writes.written([3] * 40 + [1], 40, {1: "eos"}) == ([3] * 40, None, True)
