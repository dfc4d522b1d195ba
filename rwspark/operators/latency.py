"""Latency of streaming translation from word lags: AL, LAAL, DAL and a computation-aware approximation, and read/write policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def waitk(tokens: DataFrame, k: int) -> DataFrame:
    """Commits of wait-k: after every k words read, and at the end unless the last commit was there. id, n, m, commit, at (from 1)."""
    steps = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i % k == 0) | (i == F.col("n")))
    return tokens.select("id", "n", "m", F.posexplode(steps).alias("at", "commit")).withColumn("at", F.col("at") + 1)


def drained(reads: DataFrame) -> DataFrame:
    """Commits of a policy (id, n, m, i, fires), with a last one at n if there is none yet or the last is earlier; exhausted: no read fired."""
    w = Window.partitionBy("id")
    rows = reads.withColumn("any", F.max(F.col("fires").cast("int")).over(w) == 1)
    rows = rows.filter("fires OR i = n").withColumn("at", F.row_number().over(w.orderBy("i")))
    return rows.select("id", "n", "m", F.col("i").alias("commit"), "at", (~F.col("any")).alias("exhausted"))


def lags(commits: DataFrame) -> DataFrame:
    """g, the lag of each target word: the m words are shared out evenly over the commits (halves to even), each has its commit's position."""
    rows = commits.withColumn("c", F.count("*").over(Window.partitionBy("id")))
    edge = lambda k: F.bround(k * F.col("m").cast("double") / F.col("c")).cast("int")
    rows = rows.withColumn("w", edge(F.col("at")) - edge(F.col("at") - 1))
    rows = rows.groupBy("id", "n", "m").agg(F.array_sort(F.collect_list(F.struct("at", "commit", "w"))).alias("c"), F.count("*").alias("chunks"))
    return rows.select("id", "n", "m", "chunks", F.flatten(F.transform("c", lambda x: F.array_repeat(x["commit"], x["w"]))).alias("g"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)


def _delays(g: Column, ratio: Column) -> Column:
    return F.transform(g, lambda x, i: x - i * ratio)


def average_lagging(g: Column, x: Column, y: Column) -> Column:
    """Up to the first word that waits for the whole source; null if a side is empty."""
    whole = F.coalesce(F.get(F.filter(F.transform(g, lambda v, i: F.when(v >= x, i + 1)), lambda v: v.isNotNull()), F.lit(0)), F.size(g))
    return F.when((x > 0) & (y > 0), _mean(_delays(F.slice(g, 1, whole), x.cast("double") / y)))


def length_adaptive(g: Column, x: Column, y: Column) -> Column:
    """Over all target words, with the length of the output."""
    return F.when((x > 0) & (y > 0), _mean(_delays(g, x.cast("double") / y)))


def length_adaptive_published(g: Column, x: Column, y: Column, ref: Column) -> Column:
    """As published: the larger of the two target lengths, and up to the first word that waits for the whole source."""
    whole = F.coalesce(F.get(F.filter(F.transform(g, lambda v, i: F.when(v >= x, i + 1)), lambda v: v.isNotNull()), F.lit(0)), F.size(g))
    return F.when((x > 0) & (y > 0), _mean(_delays(F.slice(g, 1, whole), x.cast("double") / F.greatest(y, ref))))


def differentiable(lagged: DataFrame) -> DataFrame:
    """DAL of each id: g'_i = max(g_i, g'_(i-1) + r), which is i r + the running maximum of g_k - k r (0 at least)."""
    r = F.col("n").cast("double") / F.col("m")
    rows = lagged.select("id", "n", "m", F.posexplode("g").alias("i", "v")).withColumn("k", F.col("i") + 1)
    top = F.max(F.col("v") - F.col("k") * r).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    delayed = F.col("k") * r + F.greatest(top, F.lit(0.0))
    return rows.withColumn("x", delayed - F.col("i") * r).groupBy("id").agg(F.avg("x").alias("dal"))


def computation_aware(al: Column, wall: Column, words: Column, rate: float, mean_words: Column) -> Column:
    """AL and half the time that the output of a sentence takes, in source words."""
    return al + wall / words * rate * (mean_words / 2)


#: Policies by name: predicates over i (words read) and the scores p_eor, rank_eor and p_other (the best other token).
POLICIES = {
    "wait_k": lambda k=3: F.col("i") % k == 0,
    "check_argmax": lambda: F.col("rank_eor") == 1,
    "check_prob_thresh": lambda theta=0.10: F.col("p_eor") > theta,
    "check_rank": lambda r=3: F.col("rank_eor") <= r,
    "check_ratio": lambda ratio=0.5: F.when(F.col("p_other") <= 0, True).otherwise(F.col("p_eor") / F.nullif("p_other", F.lit(0.0)) > ratio),
}


def policy(name: str, **options) -> Column:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name}; there are {', '.join(sorted(POLICIES))}")
    return POLICIES[name](**options)
