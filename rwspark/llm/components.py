"""Connected components of links by alternating large-star and small-star steps, each a grouped minimum and a join.

The minima are broadcast where links were counted to be few; else the neighbours of a node with very many of them (a star's
centre) are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, discard, hot_keys, written


def _settled(links: DataFrame) -> tuple[bool, int]:
    """Whether ``links`` (a > b) are stars, each centre the least of its component, as no node has two links down or links both ways; and how many they are."""
    ways = links.select("a", F.lit(1).alias("down")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("down")))
    nodes = ways.groupBy("a").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    n, apart = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.coalesce(F.bool_or((F.col("down") > 0) & (F.col("all") > 1)), F.lit(False))).first()
    return not apart, n


def _star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
    """pairs: (a, b). Each a's neighbours are linked to the least of them and a; of a large star the larger neighbours, of a small star the smaller ones and a. Links may come twice."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(F.broadcast(least), "a") if few else dealt_join(pairs, least, "a", "b", hot_keys(pairs, "a")[0])
    found = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return found.filter("a <> b")


def components(edges: DataFrame, most: int = 100, few: int = 200_000) -> DataFrame:
    """node, component (the least node it reaches) of all nodes of ``edges`` (a, b: long). Each round writes its links to the shared folder; no link is collected, and of up to ``few`` links the minima are broadcast."""
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most):
        done, n = _settled(links)
        if done:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        big = _star(both, True, n <= few)
        big = big if n <= few else written(big.distinct(), "links")
        small = written(_star(big, False, n <= few).distinct(), "links")
        discard(links, *[big] * (n > few))
        links = small
    else:
        raise RuntimeError("components have not settled")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
