"""Entropic optimal transport between next-token distributions on the union of their largest entries: Sinkhorn's scaling, in Arrow batches.

The cost is one less the cosine of the entries' vectors; the result is the transport cost without the entropy term. The kernel's
exponentials are computed once; scalings that grow large are taken into it (absorbed), so small ``eps`` doesn't overflow, and the
rounds end when the marginals are met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TINY, FAR = 1e-290, 1e60


def support(p: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest entries; ties go to the lower position."""
    return np.lexsort((np.arange(len(p)), -p))[:k]


def supports(p: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of p and q the union of both supports, each position once, padded to the longest; and which places are no padding."""
    if p.shape[1] <= k:
        at = np.broadcast_to(np.arange(p.shape[1]), p.shape)
        return at, np.ones(at.shape, bool)
    rows = [np.unique(np.concatenate((support(x, k), support(y, k)))) for x, y in zip(p, q)]
    real = np.arange(max(map(len, rows)))[None, :] < np.array([len(r) for r in rows])[:, None]
    at = np.zeros(real.shape, int)
    at[real] = np.concatenate(rows)
    return at, real


def _cost(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)
    return np.maximum(1.0 - unit @ np.swapaxes(unit, -1, -2), 0.0)


def single(p: np.ndarray, q: np.ndarray, vectors: np.ndarray, k: int = 128, eps: float = 0.05, rounds: int = 200) -> float:
    return float(batched(np.array([p]), np.array([q]), vectors, k, eps, rounds)[0])


def batched(p: np.ndarray, q: np.ndarray, vectors: np.ndarray, k: int = 128, eps: float = 0.05, rounds: int = 200, close: float = 1e-9) -> np.ndarray:
    """Costs of rows of p and q. ``close``: the rounds end when no row's marginal is further off, in all."""
    at, real = supports(p, q, k)
    a, b = (np.where(real, np.take_along_axis(x, at, 1), 0.0) for x in (p, q))
    a, b = a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
    cost = _cost(vectors[at[:1]] if p.shape[1] <= k else vectors[at])  # one for all rows where all have the whole vocabulary
    f, g = np.broadcast_to(cost.min(2), a.shape).copy(), np.zeros_like(a)
    kernel = np.exp((cost.min(2)[:, :, None] - cost) / eps)
    u, v = np.ones_like(a), np.ones_like(b)

    def times(x: np.ndarray, turned: bool = False) -> np.ndarray:
        own = np.swapaxes(kernel, 1, 2) if turned else kernel
        return x @ own[0].T if len(own) == 1 else (own @ x[:, :, None])[:, :, 0]

    for n in range(rounds):
        u = a / np.maximum(times(v), TINY)
        v = b / np.maximum(times(u, True), TINY)
        if max(u.max(), v.max()) > FAR:
            f, g = f + eps * np.log(np.where(u > 0, u, 1.0)), g + eps * np.log(np.where(v > 0, v, 1.0))
            kernel = np.exp(np.minimum((f[:, :, None] + g[:, None, :] - cost) / eps, 600.0))
            u, v = (u > 0).astype(float), (v > 0).astype(float)
        if n % 10 == 9 and np.abs(u * times(v) - a).sum(1).max() < close:
            break
    kernel = kernel * cost
    return (u * times(v)).sum(1)


def costs(pairs: DataFrame, vectors: np.ndarray, k: int = 128, eps: float = 0.05, rounds: int = 200) -> DataFrame:
    """id (of any type) and ot of pairs (id, p, q: distributions over the rows of ``vectors``, a table of bounded size)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = pairs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, p, q = batch.slice(at, 64).columns
                found = batched(np.array(p.to_pylist()), np.array(q.to_pylist()), shared.value, k, eps, rounds)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.float64())], names=["id", "ot"])

    return pairs.select("id", "p", "q").mapInArrow(run, StructType([pairs.schema["id"], StructField("ot", DoubleType())]))
