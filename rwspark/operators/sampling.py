"""Samples with quotas, and splits by group; the order is that of an MD5 of seed and key, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))


def stratified(rows: DataFrame, by: str, quota: Column | int, key: str = "index", seed: str = "0", most: int | None = None) -> DataFrame:
    """The first rows of each stratum by hash, as many as its quota. ``most``: an upper bound of all quotas, by which Spark keeps that many rows only of a stratum before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(ordered(key, seed), key))
    rows = rows.withColumn("_rank", rank)
    return (rows if most is None else rows.filter(F.col("_rank") <= most)).filter(F.col("_rank") <= quota).drop("_rank")


def balanced(rows: DataFrame, n: int, by: str = "latency", key: str = "index", seed: str = "0") -> DataFrame:
    """A third of n for each latency; what n leaves over is taken from medium."""
    return stratified(rows, by, F.when(F.col(by) == "medium", n - 2 * (n // 3)).otherwise(n // 3), key, seed, n)


def direction_quota(rows: DataFrame, n: int, key: str = "index", seed: str = "0") -> DataFrame:
    """n rows of each direction, numbered on through the directions in order. The numbers need the directions' counts only."""
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(ordered(key, seed), key))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= n)
    sizes = rows.groupBy("direction").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("direction").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")  # a row for each direction
    return rows.join(sizes.select("direction", before.alias("before")), "direction").withColumn("running", F.col("before") + F.col("rank") - 1).drop("before", "rank")


def group_split(rows: DataFrame, share: float = 0.05, key: str = "index", seed: str = "0", least: int = 20) -> DataFrame:
    """``split``: eval for max(1, int(share * keys)) keys, first by hash, train for others; rows that share a key stay together.

    The cut is the hash of the key at that rank: a threshold, found by one top-k, not a ranking of all keys in one task.
    """
    keys = rows.select(key).distinct()
    count = keys.count()
    if share <= 0 or rows.count() <= least:
        return rows.withColumn("split", F.lit("train"))
    n = max(1, int(count * share))
    held = keys.orderBy(ordered(key, seed), key).limit(n).withColumn("_held", F.lit(True))
    return rows.join(held, key, "left").withColumn("split", F.when(F.col("_held"), "eval").otherwise("train")).drop("_held")
