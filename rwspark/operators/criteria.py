"""Divergences of next-token distributions under one interface, by name: js and kl as columns, ot in Arrow batches; and all three over arrays, for models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rwspark import functions as R

from . import transport


def js(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.maximum(p, R.EPS), np.maximum(q, R.EPS)
    mean = (p + q) / 2
    return 0.5 * (p * np.log(p / mean) + q * np.log(q / mean)).sum(1)


def kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.maximum(p, R.EPS), np.maximum(q, R.EPS)
    return (p * np.log(p / q)).sum(1)


#: Over arrays of rows; ot also takes the vectors of the vocabulary.
ARRAYS: dict[str, Callable[..., np.ndarray]] = {"js": js, "kl": kl, "ot": transport.batched}


def named(criterion: str) -> Callable[..., np.ndarray]:
    if criterion not in ARRAYS:
        raise ValueError(f"unknown criterion {criterion}; there are {', '.join(sorted(ARRAYS))}")
    return ARRAYS[criterion]


def between(rows: DataFrame, criterion: str, vectors: np.ndarray | None = None, **options) -> DataFrame:
    """id (of any type) and d of rows (id, p, q). ``vectors`` are those of the vocabulary, for ot; so are the options."""
    named(criterion)
    if criterion == "ot":
        if vectors is None:
            raise ValueError("ot needs the vectors of the vocabulary")
        return transport.costs(rows, vectors, **options).withColumnRenamed("ot", "d")
    return rows.select("id", R.criterion(criterion)(F.col("p"), F.col("q")).alias("d"))
