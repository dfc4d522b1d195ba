from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rwspark.llm import importance as I
from rwspark.llm import queries


def brute(rows, target, sizes=(1, 1), buckets=10_000, percent=10, least=20, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def found(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]

    own = [found(t) for _, t in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in found(x)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for (doc_id, _), (n, f) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return sorted(map(str, map(tuple, out)))


def test_query_matches_brute_force(spark, small):
    got = queries.QUERIES["op12_importance_resampling"](spark, small).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(rows, [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == sorted(str((a, f, w, s, k)) for a, _, f, w, s, k in map(eval, want))
    assert sum(r["rank"] is not None for r in got) == len([1 for x in map(eval, want) if x[1] >= 20]) // 10


@pytest.mark.parametrize("block", [1, 40, I.BLOCK])
def test_edges_and_blocks(spark, docs, edge_texts, block):
    texts = [*edge_texts, *(f"common word {k} " * (k % 9 + 1) for k in range(60))]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "common " * 30, "en", "s"), (7, texts[20], "en", "s"), (7, texts[20], "en", "s")]
    frame = docs(rows, extra=True)
    blocks = I.streams(frame, (1, 2), 97, block=block)
    assert blocks.agg(F.sum(F.length("stream")) / 2 == F.sum(F.element_at("ends", -1))).first()[0]
    want = brute([(a, t) for a, t, _, _ in rows], ["Common words", None, ""], (1, 2), 97, 35, 3)
    target = spark.createDataFrame([("Common words",), (None,), ("",)], "text string")
    gain = I.gains(I.counts(blocks, 97), I.counts(I.streams(target.withColumn("doc_id", F.lit(1)), (1, 2), 97), 97), 97)
    import numpy as np

    scored = I.noisy(I.weights(blocks, np.array([r.gain for r in gain.orderBy("bucket").collect()])))
    got = I.ranked(scored, 35, 3).select("id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    whole = I.resampled(frame, target, (1, 2), 97, 35, 3).select("id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in whole) == want


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, 50, 50, 5, 100 - k // 4) for k in range(40)] + [(None, 50, 50, 5, 100)]
    got = I.ranked(spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long"), 30).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r.id for r in got] == [None, *range(11)] and [r["rank"] for r in got] == list(range(1, 13))


def test_empty_tables(spark, docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert I.resampled(docs([]), target).count() == 0
    got = I.resampled(docs(["a b", "c"]), target.limit(0)).collect()
    assert len(got) == 2 and all(r["rank"] is None for r in got)
    with pytest.raises(ValueError):
        I.streams(docs(["a"]), buckets=70_000)
