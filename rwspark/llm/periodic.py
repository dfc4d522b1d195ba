"""Periodic runs of words: block matching over aligned power-of-two blocks, then exact extension.

A run is a stretch of consecutive words whose words q apart are equal, q being its least period, that no neighbouring word
extends, of at least ``least`` words and two periods. For L = 2, 4, 8, ... the aligned blocks of L words are the keys of an
automaton over word numbers, which the whole document is searched with. The first length - q words of a run with period q
hold an aligned block of one scale at least, and the block occurs again q words on: each scale takes the distances that are
its own, and each such pair of occurrences is extended in both directions, word by word.

Work stays near n log n: a block is a key only where both its halves occur again, and what a run with a smaller period
already explains is neither searched nor extended. Documents are independent; there is no shuffle, and a lost task is run
again alone. A document of any length is read as a whole.

Null and empty texts have no words and no runs. Repeated rows are judged alike, each on its own. A null id is kept. An empty
table gives an empty table. ``keep`` columns go through unread; one that has a name of the result has ``kept_`` put in front.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, per_batch, utf8

RESULT = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def scales(n: int, least: int) -> dict[int, tuple[int, int]]:
    """Block sizes for n words, smallest first, each with the least and the greatest period that it finds.

    A run repeats max(period, least / 2) words at least, and a stretch of 2L - 1 words holds an aligned block of L.
    """
    found, size, near = {}, 1 << (-(-least // 2) + 1 >> 1).bit_length() - 1, 1
    while near <= n // 2:
        found[size] = near, min(4 * size - 2, n // 2)
        near, size = 4 * size - 1, 2 * size
    return found


def occurrences(names: np.ndarray, step: int, size: int, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, place) of all occurrences of the blocks of ``size`` words at ``starts``; equal blocks have the number of the first.

    ``names`` numbers the stretches of ``step`` words at all places. A block is the sequence of its size / step numbers, and
    the document is ``step`` such sequences, side by side: keys stay short, and so do the automaton's chains of suffixes.
    """
    import ahocorasick

    search, end = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), n + 1
    for i in starts.tolist():
        key = tuple(names[i : i + size : step].tolist())
        if key not in search:
            search.add_word(key, i)
    search.make_automaton()
    rows = -(-n // step) + 1  # the last one is empty and parts the sequences
    grid = np.full(rows * step, end)
    grid[: len(names)] = names
    found = np.array(list(search.iter(tuple(grid.reshape(rows, step).T.ravel().tolist()))), np.int64).reshape(-1, 2)
    return found[:, 1], found[:, 0] % rows * step + found[:, 0] // rows - size + step


def extended(word: np.ndarray, start: int, size: int, period: int) -> tuple[int, int]:
    """The whole stretch around a block and its repetition in which words ``period`` apart are equal: start and end."""

    def reach(a: np.ndarray, b: np.ndarray) -> int:
        at, step = 0, 64
        while at < len(a):
            differ = a[at : at + step] != b[at : at + step]
            if differ.any():
                return at + int(differ.argmax())
            at, step = at + len(differ), 2 * step
        return at

    left = reach(word[:start][::-1], word[period : start + period][::-1])
    right = reach(word[start + size : len(word) - period], word[start + size + period :])
    return start - left, start + size + period + right


def runs(ids: tuple[int, ...], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, by start and period."""
    n, word = len(ids), np.unique(np.array(ids, np.int64), return_inverse=True)[1]
    known: dict[int, list[tuple[int, int]]] = {}  # of each period its runs: start and end
    if n < max(least, 2):
        return []
    again, below = np.bincount(word)[word] > 1, 1  # of each block of the scale below: it may occur again
    names, step = word, 1
    for size, (near, far) in scales(n, least).items():
        while below < size:
            again, below = again[: len(again) // 2 * 2].reshape(-1, 2).all(1), 2 * below
        starts = np.flatnonzero(again) * size
        for a, end in (r for q in known if q <= size for r in known[q]):  # all that a block well inside a short-period run can find is that run
            starts = starts[(starts < a) | (starts + far + size > end)]
        if not len(starts):
            continue
        while step < size // 16:
            pairs = names[:-step] * (n + 1) + names[step:]
            names, step = np.unique(pairs, return_inverse=True)[1], 2 * step
        block, place = occurrences(names, step, size, starts, n)
        key = np.sort(block * (n + 1) + place)  # by block, then by place
        of = np.zeros(n, np.int64)
        of[place] = block
        base = of[starts] * (n + 1)
        last = key[np.searchsorted(key, base + n, "right") - 1] - base
        again[starts // size] = last > starts
        a, b = (np.searchsorted(key, base + np.minimum(starts + d, n), side) for d, side in ((near, "left"), (far, "right")))
        count = np.maximum(b - a, 0)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        begin = np.repeat(starts, count)
        distance = key[at] % (n + 1) - begin
        order = np.lexsort((begin, distance))
        begin, distance = begin[order], distance[order]
        cuts = [0, *(np.flatnonzero(np.diff(distance)) + 1).tolist(), len(distance)]
        for lo, hi in zip(cuts, cuts[1:] if len(distance) else ()):
            q, seeds = int(distance[lo]), begin[lo:hi]
            for a, end in (r for p in known if q % p == 0 for r in known[p]):
                seeds = seeds[(seeds < a) | (seeds + size + q > end)]
            while len(seeds):
                a, end = extended(word, int(seeds[0]), size, q)
                if end - a >= max(least, 2 * q):
                    known.setdefault(q, []).append((a, end))
                seeds = seeds[seeds + size + q > end]
    return sorted((a, end - a, q) for q, found in known.items() for a, end in found)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for a, length, q in found:
        kept[a + q : a + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: int = 12) -> DataFrame:
    """Of each document: id, ``keep`` columns, n_words, runs by start and period (word numbers from 0), and the collapsed text."""
    names, types = free_names((id_col, *keep), RESULT), dict(docs.dtypes)
    schema = ", ".join([f"`{n}` {types[c]}" for n, c in zip(names, (id_col, *keep))] + [f"{c} {t}" for c, t in RESULT.items()])

    def make(batch: pa.RecordBatch) -> list:
        n_words, all_runs, texts = [], [], []
        for text in batch.column(batch.num_columns - 1):
            words = text.as_py().split()  # bytes: at ASCII white space only
            code: dict[bytes, int] = {}
            ids = tuple([code.setdefault(w, len(code)) for w in words])
            found = runs(ids, least)
            n_words.append(len(words))
            all_runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
            texts.append(collapsed(words, found).decode())
        return [*batch.columns[: len(names)], n_words, all_runs, texts]

    return per_batch(docs.select(*(F.col(c).alias(n) for n, c in zip(names, (id_col, *keep))), utf8(text_col)), schema, make)
