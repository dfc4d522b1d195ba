"""Columns that depend on a few keys only, made once for each of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cached(rows: DataFrame, keys: list[str], most: int = 10_000, **made: Column) -> DataFrame:
    """``rows`` with the columns ``made`` of ``keys``, computed for the distinct keys. Nulls are keys like others.

    The distinct keys are counted: up to ``most`` are broadcast, more are joined by a shuffle.
    """
    few = rows.select(*keys).distinct().select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(x.alias(name) for name, x in made.items()))
    few = F.broadcast(few) if few.count() <= most else few
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    return rows.join(few, same).drop(*(f"_key_{k}" for k in keys))
