"""Annotation of pairs: a scorer gives divergence cells, and the commit algebra makes chunks of them.

A scorer takes (id, s, t, n, m) and returns (id, n, m, i, j, d). ``external`` wraps a Python model; the others are model-free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from rwspark import functions as R
from rwspark import sources

from . import commit, criteria, transport, within

Scorer = Callable[[DataFrame], DataFrame]


def _beside(pairs: DataFrame, names: list[str], made: Callable[[pa.RecordBatch], list[list[np.ndarray]]], most: int = 256) -> DataFrame:
    """``pairs`` with columns ``names``, of each pair an array with a number for each prefix: ``made`` of at most ``most`` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                found = [pa.array(x, pa.list_(pa.float64())) for x in made(part)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *names])

    return pairs.mapInArrow(run, StructType([*pairs.schema, *(StructField(x, ArrayType(DoubleType())) for x in names)]))


def seen(words: list, n: int) -> np.ndarray:
    """How often each distinct word is among the first 1, 2, ..., n, a row each."""
    known: dict = {}
    place = np.array([known.setdefault(w, len(known)) for w in words[:n]], int)
    return (place[:, None] == np.arange(len(known))).cumsum(0)


def with_divergence(pairs: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """``pairs`` (n, s and others) with js, kl and entropy of each prefix: its smoothed word distribution against that of the whole source, over the source's own words."""

    def made(part: pa.RecordBatch) -> list[list[np.ndarray]]:
        out: list[list[np.ndarray]] = [[], [], []]
        for words, n in zip(part.column("s").to_pylist(), part.column("n").to_pylist()):
            counts = seen(words, n)
            p = (counts + smoothing) / (np.arange(1, n + 1)[:, None] + smoothing * counts.shape[1])
            q = p[-1]
            mean = (p + q) / 2
            for found, x in zip(out, (0.5 * (p * np.log(p / mean) + q * np.log(q / mean)), q * np.log(q / p), -p * np.log(p))):
                found.append(x.sum(1))
        return out

    return _beside(pairs, ["js", "kl", "entropy"], made)


def prefix_divergence(tokens: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """id, n, m, i, js, kl and entropy of all prefixes, a row each."""
    rows = with_divergence(tokens.select("id", "n", "m", "s"), smoothing)
    rows = rows.select("id", "n", "m", F.explode_outer(F.arrays_zip(F.sequence(F.lit(1), F.col("n")).alias("i"), "js", "kl", "entropy")).alias("x"))
    return rows.select("id", "n", "m", "x.i", "x.js", "x.kl", "x.entropy")


def shares(places: np.ndarray, buckets: int, smoothing: float, most: int) -> Iterator[np.ndarray]:
    """Smoothed distributions over ``buckets`` of the first 1, 2, ... places, a row each, in stretches of at most ``most`` rows: counts go on from one to the next."""
    before = np.zeros(buckets, int)
    for at in range(0, len(places), most):
        counts = before + (places[at : at + most, None] == np.arange(buckets)).cumsum(0)
        before = counts[-1]
        yield (counts + smoothing) / (np.arange(at + 1, at + len(counts) + 1)[:, None] + smoothing * buckets)


def with_transport(pairs: DataFrame, buckets: int = 64, smoothing: float = 0.1, most: int = 1024, **options) -> DataFrame:
    """``pairs`` (n, s and others) with ot of each prefix: the transport cost from its smoothed word distribution to that of the whole source.

    Words fall into ``buckets`` by their ids, and the buckets' vectors lie on a circle: a stand-in for a model's vocabulary and
    its embeddings, which an ``external`` scorer brings along. Distributions of at most ``most`` prefixes are held at once.
    """
    angle = 2 * np.pi * np.arange(buckets) / buckets
    vectors = np.stack((np.cos(angle), np.sin(angle)), 1)

    def made(part: pa.RecordBatch) -> list[list[np.ndarray]]:
        found: list[list[np.ndarray]] = [[np.zeros(0)] for _ in range(part.num_rows)]
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            p, q = np.concatenate([x for _, x, _ in waiting]), np.concatenate([np.broadcast_to(whole, x.shape) for _, x, whole in waiting])
            for (k, _, _), cost in zip(waiting, np.split(transport.batched(p, q, vectors, **options), np.cumsum([len(x) for _, x, _ in waiting])[:-1])):
                found[k].append(cost)
            waiting.clear()

        for k, (given, n) in enumerate(zip(part.column("_places").to_pylist(), part.column("n").to_pylist())):
            places = np.array(given[:n], int)
            whole = (np.bincount(places, minlength=buckets) + smoothing) / (n + smoothing * buckets)
            for x in shares(places, buckets, smoothing, most):
                if waiting and sum(len(y) for _, y, _ in waiting) + len(x) > most:
                    settle()
                waiting.append((k, x, whole))
        if waiting:
            settle()
        return [[np.concatenate(x) for x in found]]

    places = F.transform("s", lambda w: F.pmod(R.word_id(w), F.lit(buckets)))
    return _beside(pairs.withColumn("_places", places), ["ot"], made, 8).drop("_places")


def prefix_transport(tokens: DataFrame, buckets: int = 64, smoothing: float = 0.1, **options) -> DataFrame:
    """id, n, m, i and ot of all prefixes, a row each."""
    rows = with_transport(tokens.select("id", "n", "m", "s"), buckets, smoothing, **options).select("id", "n", "m", F.posexplode_outer("ot").alias("i", "ot"))
    return rows.select("id", "n", "m", (F.col("i") + 1).alias("i"), "ot")


#: Divergences of a prefix from the whole source by name: functions of pairs that give (id, n, m, i, <name>).
PREFIX_CRITERIA = {"js": prefix_divergence, "kl": prefix_divergence, "entropy": prefix_divergence, "ot": prefix_transport}


#: The same beside the pairs, as an array of each.
BESIDE = {"js": with_divergence, "kl": with_divergence, "entropy": with_divergence, "ot": with_transport}


def _known(criterion: str) -> None:
    if criterion not in PREFIX_CRITERIA:
        raise ValueError(f"unknown criterion {criterion}; there are {', '.join(sorted(PREFIX_CRITERIA))}")


def prefix_scorer(tokens: DataFrame, criterion: str = "js") -> DataFrame:
    _known(criterion)
    rows = PREFIX_CRITERIA[criterion](tokens)
    return rows.select("id", "n", "m", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.col(criterion).alias("d"))


#: What a model gives: for equally many lists of source and target words, of each target the distributions over the vocabulary at its places, a row each.
Model = Callable[[list[list[str]], list[list[str]]], list[np.ndarray]]


def scored(sources_: list[list[str]], targets: list[list[str]], model: Model, divergence: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 32) -> list[np.ndarray]:
    """Of each pair the divergences from the whole source, a row for each prefix.

    Prefixes of many pairs are bucketed by their length, and a bucket of at most ``most`` is one call of the model; the whole sources come
    first, and no other distributions are held than theirs and a bucket's.
    """
    found = [np.zeros((len(s), len(t))) for s, t in zip(sources_, targets)]
    whole: dict[int, np.ndarray] = {}
    for last in (True, False):
        buckets: dict[int, list[int]] = {}
        for k, s in enumerate(sources_):
            for i in ([len(s)] if last else range(1, len(s))):
                buckets.setdefault(i, []).append(k)
        for i, members in sorted(buckets.items()):
            for at in range(0, len(members), most):
                own = members[at : at + most]
                given = model([sources_[k][:i] for k in own], [targets[k] for k in own])
                if last:
                    whole.update(zip(own, given))
                sizes = np.cumsum([len(targets[k]) for k in own])[:-1]
                values = divergence(np.concatenate(given), np.concatenate([whole[k] for k in own]))
                for k, row in zip(own, np.split(values, sizes)):
                    found[k][i - 1] = row
    return found


def external(model: Model, criterion: str = "js", pairs: int = 64, most: int = 32, vectors: np.ndarray | None = None, **options) -> Scorer:
    """A scorer from a model: the ``criterion`` (of ``criteria``) between what it expects after a prefix and after the whole source.

    ``pairs`` are scored together, in calls of at most ``most`` prefixes. ``vectors`` and ``options`` are those of ot.
    """
    own = criteria.named(criterion)
    extra = ((vectors,), options) if criterion == "ot" else ((), {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), pairs):
                part = frame.iloc[at : at + pairs]
                s, t = ([list(x) for x in part[c]] for c in "st")
                found = scored(s, t, model, lambda p, q: own(p, q, *extra[0], **extra[1]), most)
                cells = [x.size for x in found]
                i, j = (np.concatenate([np.indices(x.shape)[axis].ravel() for x in found]) for axis in (0, 1))
                columns = {c: np.repeat(part[c].to_numpy(), cells) for c in ("id", "n", "m")}
                yield pd.DataFrame(columns | {"i": i + 1, "j": j, "d": np.concatenate([x.ravel() for x in found])})

    return lambda tokens: tokens.select("id", "s", "t", "n", "m").mapInPandas(run, "id long, n int, m int, i int, j int, d double")


SCORERS: dict[str, Scorer] = {"hash": sources.cells, "prefix": prefix_scorer}


def matrices(cells: DataFrame) -> DataFrame:
    """id and matrix: the divergences of a pair, a row for each prefix that was scored, in their order."""
    rows = cells.groupBy("id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "d")))["d"].alias("d"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "d")))["d"].alias("matrix"))


def annotate(
    tokens: DataFrame, scorer: str | Scorer = "hash", tau: float = 0.05, stride: int = 1, boundaries: DataFrame | None = None,
    criterion: str = "js", full_matrix: bool = False, record_entropy: bool = False, prompt_mode: str | None = None,
) -> DataFrame:
    """id, n, m, chunks, sum_commit, source_chunks and target_chunks of pairs (id, s, t, n, m). The stride leaves out prefixes, but never the whole source.

    ``criterion`` is that of the prefix scorer. More columns on demand: matrix (of the prefixes that were scored), entropy (that of the
    source's word distribution after each of them), and prompt, what a model reads before the target (for a mode of
    ``annotator_prompt``, from src_lang and tgt_lang of the pairs).
    """
    at = lambda i: (i == F.col("n")) | ((i - 1) % stride == 0)
    cells = None
    if scorer not in ("prefix", "hash") or full_matrix:
        cells = prefix_scorer(tokens, criterion) if scorer == "prefix" else (SCORERS[scorer] if isinstance(scorer, str) else scorer)(tokens)
        cells = cells.filter(at(F.col("i"))) if stride > 1 else cells
    if scorer in ("prefix", "hash"):
        out = _within(tokens, scorer, tau, at, boundaries, criterion)
    else:
        trace = commit.traces(cells, tau)
        texts = commit.texts(commit.chunked(trace, tokens, boundaries), tokens)
        out = commit.summaries(trace).select("id", "n", "m", "chunks", "sum_commit").join(texts, "id")
    if full_matrix:
        out = out.join(matrices(cells), "id")
    if record_entropy:
        own = F.transform(F.filter(F.arrays_zip(F.sequence(F.lit(1), F.col("n")).alias("i"), "entropy"), lambda x: at(x["i"])), lambda x: x["entropy"])
        out = out.join(with_divergence(tokens.select("id", "n", "m", "s")).select("id", own.alias("entropy")), "id")
    if prompt_mode is not None:
        out = out.join(tokens.select("id", R.annotator_prompt(F.array_join("s", " "), R.language_name(F.col("src_lang")), R.language_name(F.col("tgt_lang")), prompt_mode).alias("prompt")), "id")
    return out


def _within(tokens: DataFrame, scorer: str, tau: float, at: Callable[[Column], Column], boundaries: DataFrame | None, criterion: str) -> DataFrame:
    """``annotate`` by a scorer of the library, each pair in its row."""
    rows = tokens.select("id", "s", "t", "n", "m")
    if scorer == "hash":
        rows = within.traced(rows, lambda i, j: F.when(at(i), sources.divergence(i, j)).otherwise(float("nan")), tau)
    else:  # the divergence of a prefix is the same for all target words, so they all commit at once
        _known(criterion)
        first = F.array_position(F.transform(criterion, lambda d, k: F.coalesce(at(k + 1) & ~F.isnan(d) & (d < tau), F.lit(False))), True).cast("int")
        run = F.struct(F.when(first > 0, first).otherwise(F.col("n")).alias("commit"), F.lit(0).alias("first"), (F.col("m") - 1).alias("last"))
        rows = BESIDE[criterion](rows).withColumn("runs", F.array(run))
    if boundaries is not None:
        rows = rows.join(boundaries, "id", "left")
    stops = None if boundaries is None else F.coalesce("at", F.array().cast("array<int>"))
    rows = within.texts(rows.withColumn("chunks", within.chunks(F.col("runs"), stops)))
    rows = rows.withColumn("_s", within.summary(F.col("runs")))
    return rows.select("id", "n", "m", "_s.chunks", "_s.sum_commit", "source_chunks", "target_chunks")
