"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of a test item (a shorter item is one window). The text is a sequence of
words. The table of block shifts says, for two adjacent words, how far the search may skip; blocks that end a pattern's
prefix select a bucket of patterns, and a direct comparison confirms an occurrence. Patterns are put in classes by length,
so that one short item doesn't shorten the skips of all.

Null and empty texts have no words, no hits and are clean. Repeated items share their windows and are all named; windows of
items without an id are searched for like all others, only that there is no name to give. Repeated documents are judged alike,
each on its own. Without test items all documents are clean, and without documents there are no rows. A document of any
length is searched as a whole. ``keep`` columns go through; one that has a name of the result has ``kept_`` put in front.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, per_batch, utf8

#: Of a byte: A-Z in lower case, digits, a-z and all bytes beyond ASCII stay, the rest is a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class WuManber:
    """Search for many word sequences at once."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str | None]]):
        classes: dict[int, list[tuple[bytes, ...]]] = {}
        for p in patterns:
            classes.setdefault(len(p).bit_length() if len(p) < 8 else 8 + (len(p) >= 13), []).append(p)
        self.tables = []
        for group in classes.values():
            m = min(map(len, group))
            block = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for p in group:
                for j in range(block, m + 1):
                    key = p[j - 1] if block == 1 else (p[j - 2], p[j - 1])
                    shift[key] = min(shift.get(key, m), m - j)
                buckets.setdefault(key, []).append((list(p), patterns[p]))
            self.tables.append((m, block, shift, buckets))

    def search(self, text: list[bytes]) -> list[tuple[int, int, list[str | None]]]:
        """(start, end, items) of each occurrence."""
        found, n = [], len(text)
        for m, block, shift, buckets in self.tables:
            i, far, get = m - 1, m - block + 1, shift.get
            while i < n:
                key = text[i] if block == 1 else (text[i - 1], text[i])
                skip = get(key, far)
                if skip:
                    i += skip
                    continue
                start = i - m + 1
                for p, items in buckets[key]:
                    if text[start : start + len(p)] == p:
                        found.append((start, start + len(p), items))
                i += 1
        return found


def windows(items: list[tuple[str | None, bytes]], size: int = 13) -> dict[tuple[bytes, ...], list[str | None]]:
    """Windows of the items, each with the items it is in."""
    found: dict[tuple[bytes, ...], dict[str | None, None]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), {})[item] = None
    return {p: list(ids) for p, ids in found.items()}


RESULT = ("n_words", "n_hit", "items", "spans", "contaminated", "_searched")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most_bytes: int = 32 << 20) -> DataFrame:
    """Of each document: id, ``keep`` columns, n_words, n_hit (words within an occurrence), items (sorted, distinct) and spans (word positions).

    The tables travel with the tasks. A benchmark of over ``most_bytes`` is searched in parts of about that size, one map
    after another over the same rows; there is no shuffle in either case.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8("text").alias("text"))
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most_bytes))
    types = dict(docs.dtypes)
    names = free_names((id_col, *keep), RESULT)
    kept = "".join(f"`{n}` {types[c]}, " for n, c in zip(names, (id_col, *keep)))
    state = "items array<string>, spans array<bigint>"
    frame = docs.select(*(F.col(c).alias(n) for n, c in zip(names, (id_col, *keep))), utf8(text_col).alias("_searched"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<bigint>").alias("spans"))
    for k in range(parts):
        rows = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()  # about most_bytes by the check above
        table = spark.sparkContext.broadcast(windows([(r.item, bytes(r.text)) for r in rows], size))
        last = k == parts - 1
        frame = per_batch(frame, kept + ("n_words bigint, n_hit bigint, " if last else "_searched binary, ") + state, _pass(last, 1 + len(keep)), lambda table=table: WuManber(table.value))
    return frame


def _pass(last: bool, kept: int):
    """One search over a batch; the last one counts."""

    def make(batch: pa.RecordBatch, search: WuManber) -> list:
        items, spans, n_words, n_hit = [], [], [], []
        for text, had, at in zip(*(c.to_pylist() for c in batch.columns[kept:])):
            w = words(text)
            found = search.search(w)
            items.append(sorted({*(had or ()), *(x for _, _, own in found for x in own if x is not None)}))
            spans.append([*(at or ()), *(x for a, b, _ in found for x in (a, b))])
            if last:
                hit = bytearray(len(w))
                for a, b in zip(spans[-1][::2], spans[-1][1::2]):
                    hit[a:b] = b"\1" * (b - a)
                n_words.append(len(w))
                n_hit.append(hit.count(1))
        return [*batch.columns[:kept], *([n_words, n_hit] if last else [batch.column(kept)]), items, spans]

    return make


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """With ``contaminated``: some words are hit, and at least one in ``share``."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
