"""Hierarchical packing of tokenized documents into windows of several lengths, without padding.

Tiers are context sizes, powers of two. A document is cut into whole windows of the longest tier, and what is left (or a
shorter document) is routed to the least tier that holds it. A tier packs its pieces from the longest on, each at the start of a
window; the gap that it leaves is filled from the shorter tiers, longest fitting piece first, and at last by cutting one piece
to the gap, whose rest is routed anew. What stays under the least tier at a task's end makes windows of smaller powers of two, so no window is padded.

A task packs its own documents, in pools of about ``pool`` ids, so memory doesn't grow with the data and nothing is shuffled;
what a pool can't place is carried to the next. Windows of a pool are dealt to step groups of about ``step`` ids, longest
first, each to the group with the fewest ids: groups differ by a window at most. A lost task is run again alone,
and gives the same windows if its rows come in the same order, as those of files do.

Null and empty texts are the end id alone. Documents of any length, repeated rows and null ids are packed like all others.
An empty table gives no windows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_records import encoder

CONTEXTS = (64, 128, 256, 512, 1024)
SCHEMA = "sequence_id bigint, context bigint, step bigint, pieces array<struct<doc_id:{id}, start:bigint, length:bigint, offset:bigint, doc_tokens:bigint>>, ids binary"


class Pool:
    """Pieces that wait for a window, by length: (length, number, document, start, ids)."""

    def __init__(self) -> None:
        self.waiting: list[tuple] = []
        self.total = self.number = 0

    def add(self, document: tuple, start: int, ids: np.ndarray) -> None:
        insort(self.waiting, (len(ids), self.number, document, start, ids), key=lambda x: x[:2])
        self.number += 1
        self.total += len(ids)

    def take(self, gap: int) -> tuple | None:
        """The longest piece of at most ``gap`` ids."""
        k = bisect_right(self.waiting, gap, key=lambda x: x[0])
        return self.gone(k - 1) if k else None

    def gone(self, k: int) -> tuple:
        piece = self.waiting.pop(k)
        self.total -= piece[0]
        return piece

    def cut(self, gap: int) -> tuple:
        """The first ``gap`` ids of the shortest piece, all of which are longer; the rest waits."""
        length, number, document, start, ids = self.gone(0)
        self.add(document, start + gap, ids[gap:])
        return gap, number, document, start, ids[:gap]

    def window(self, context: int) -> list[tuple]:
        """A full window: its longest fitting piece, then the gap."""
        pieces = []
        while context:
            pieces.append(self.take(context) or self.cut(context))
            context -= pieces[-1][0]
        return pieces


def tier(length: int, contexts: tuple[int, ...]) -> int:
    """The least context that holds a piece."""
    return next((c for c in contexts if c >= length), contexts[-1])


def packed(pool: Pool, contexts: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[tuple]]]:
    """(context, pieces) of windows, tier by tier from the longest, as long as the pool can fill them. The last pool is used up."""
    for k, context in reversed([*enumerate(contexts)]):
        below = contexts[k - 1] if k else 0
        while pool.total >= context and (pool.waiting[-1][0] > below or not k):
            yield context, pool.window(context)
    while last and pool.total:
        context = 1 << pool.total.bit_length() - 1
        yield context, pool.window(context)


def steps(sizes: list[int], step: int) -> list[int]:
    """Of each window its step group: the longest first, each to the group with the fewest ids."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step)))]
    of = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        held, of[k] = groups[0]
        heapq.heapreplace(groups, (held + sizes[k], of[k]))
    return of


def sequences(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 0, contexts: tuple[int, ...] = CONTEXTS, pool: int = 1 << 20, step: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows: sequence_id, context (its length), step, pieces (document, place of its first id in the document, length, place in the window) and ids (unsigned 32-bit, little-endian).

    Numbers of windows and steps are unique, and those of a task follow each other. tokenizer: a file's path, the same on all executors, or what gives it.
    """
    if not contexts or sorted(set(contexts)) != list(contexts) or any(c < 1 or c & (c - 1) for c in contexts):
        raise ValueError("contexts are ascending powers of two")
    longest = contexts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, waiting, whole = encoder(tokenizer() if callable(tokenizer) else tokenizer, end_id), Pool(), []
        number = group = TaskContext.get().partitionId() << 33

        def rows(schema: pa.Schema, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, group, whole
            windows = [*whole, *packed(waiting, contexts, last)]
            whole = []
            of = steps([c for c, _ in windows], step)
            out = pa.schema([("sequence_id", pa.int64()), ("context", pa.int64()), ("step", pa.int64()), ("pieces", pa.list_(pa.struct([("doc_id", schema.field(0).type), *((n, pa.int64()) for n in ("start", "length", "offset", "doc_tokens"))]))), ("ids", pa.binary())])
            for at in range(0, len(windows), 500):
                part = windows[at : at + 500]
                lists = []
                for _, pieces in part:
                    offset, own = 0, []
                    for length, _, (doc_id, tokens), start, _ in pieces:
                        own.append({"doc_id": doc_id, "start": start, "length": length, "offset": offset, "doc_tokens": tokens})
                        offset += length
                    lists.append(own)
                columns = [[number + at + i for i in range(len(part))], [c for c, _ in part], [group + g for g in of[at : at + 500]], lists, [b"".join(p[4].astype("<u4").tobytes() for p in pieces) for _, pieces in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
            number, group = number + len(windows), group + max(of, default=-1) + 1

        for batch in batches:
            for doc_id, payload in zip(batch.column(0).to_pylist(), encode.stream(batch.column(1).to_pylist())):
                ids = np.frombuffer(payload, "<u2" if encode.width == 2 else "<u4")
                document, full = (doc_id, len(ids)), len(ids) // longest * longest
                whole += ((longest, [(longest, 0, document, at, ids[at : at + longest])]) for at in range(0, full, longest))
                if full < len(ids):
                    waiting.add(document, full, ids[full:])
                if waiting.total + len(whole) * longest >= pool or len(waiting.waiting) >= pool >> 6:
                    yield from rows(batch.schema, False)
        if waiting.total or whole:
            yield from rows(batch.schema, True)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA.format(id=dict(docs.dtypes)[id_col]))


def pieces(windows: DataFrame) -> DataFrame:
    """A row for each piece of ``sequences``, with its own ids."""
    one = windows.select("sequence_id", "context", "step", "ids", F.explode("pieces").alias("piece"))
    own = F.substring("ids", (4 * F.col("piece.offset") + 1).cast("int"), (4 * F.col("piece.length")).cast("int"))
    return one.select("piece.*", "sequence_id", "context", "step", own.alias("ids"))
