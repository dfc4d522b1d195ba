"""Replays of a streaming policy with the ids that a model writes: the end of a write, words without ids, and offline output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rwspark import functions as R

from . import latency

#: The ids that end a write, and the most ids of one.
ENDS = {R.SPECIAL_IDS["eow"]: "eow", 1: "eos", R.SPECIAL_IDS["eor"]: "eor"}
CAP = 40


def written_chunk(ids: Column, cap: int = CAP, ends: dict[int, str] = ENDS) -> Column:
    """ids before the first that ends a write, ``ended`` (by which; null for none) and cap_hit: there are ``cap`` ids and no end before."""
    first = F.slice(ids, 1, cap)
    at = lambda i: F.exists(F.array(*(F.lit(e) for e in ends)), lambda e: e == i)
    place = F.coalesce(F.get(F.filter(F.transform(first, lambda x, k: F.when(at(x), k)), lambda k: k.isNotNull()), F.lit(0)), F.size(first))
    names = F.create_map(*(F.lit(x) for pair in ends.items() for x in pair))
    shape = lambda k: F.struct(F.slice(first, 1, k).alias("ids"), F.try_element_at(names, F.get(first, k)).alias("ended"), (k >= cap).alias("cap_hit"))
    return R.bound(place, shape)


def checked(fires: Column, span: Column) -> Column:
    """A policy's verdict after a word; a word without ids counts as read, but the policy isn't asked."""
    return F.coalesce(F.size(span) > 0, F.lit(False)) & fires


def offline(tokens: DataFrame, *keep: str) -> DataFrame:
    """The whole source in one chunk: id, ``keep``, n, m, chunks (1) and g, where the lag of every word is n."""
    return tokens.select("id", *keep, "n", "m", F.lit(1).alias("chunks"), F.array_repeat(F.col("n"), F.col("m")).alias("g"))


def offline_prompt(latency_name: Column, source: Column) -> Column:
    """What a model reads before it writes all: the read is closed."""
    return F.concat_ws(" ", R.by_latency(latency_name, R.LATENCY_TOKENS), source, F.lit(R.END_OF_READ))


def replayed(reads: DataFrame, ids: Column, cap: int = CAP) -> DataFrame:
    """Commits of a policy (id, n, m, i, fires) with what is written at each: ids, ended and cap_hit. ``ids`` is a model's stream at a commit, over id, at and commit."""
    rows = latency.drained(reads).withColumn("w", written_chunk(ids, cap))
    return rows.select("id", "n", "m", "commit", "at", "exhausted", "w.*")
