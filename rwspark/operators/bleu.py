"""Corpus BLEU: 13a-like tokens, clipped n-gram counts as aggregations, exponential smoothing, brevity penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words, with marks set apart unless they stand within numbers; four character references are decoded, and lines that were broken in a word are joined."""
    for name, mark in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    text = F.regexp_replace(text, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    text = F.regexp_replace(text, r"([^0-9])([\.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([\.,])([^0-9])", " $1 $2")
    text = F.regexp_replace(text, r"([0-9])(-)", "$1 $2 ")
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def _grams(side: str, most: int, hyp: int) -> Column:
    """n, gram and whose it is, for all n-grams of a side."""
    size = F.size(side)
    gram = lambda i, n: F.struct(n.alias("n"), F.array_join(F.slice(side, i, n), " ").alias("gram"), F.lit(hyp).alias("h"), F.lit(1 - hyp).alias("r"))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.least(size, F.lit(most))), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: gram(i, n))))


def corpus(rows: DataFrame, by: str = "id", most: int = 4) -> DataFrame:
    """One row: bleu, brevity, lengths and precisions, of rows (id, hyp, ref)."""
    rows = rows.select(F.col(by).alias("id"), "hyp", "ref").repartition("id").select("id", tokens(F.col("hyp")).alias("hyp"), tokens(F.col("ref")).alias("ref"))
    own = lambda side, hyp: F.when(F.size(side) > 0, _grams(side, most, hyp)).otherwise(F.array().cast("array<struct<n:int,gram:string,h:int,r:int>>"))
    grams = rows.select("id", F.explode(F.concat(own("hyp", 1), own("ref", 0))).alias("g")).groupBy("id", "g.n", "g.gram").agg(F.sum("g.h").alias("h"), F.sum("g.r").alias("r"))  # where the texts are: n-grams aren't moved
    counts = grams.filter("h > 0").groupBy("n").agg(F.sum("h").alias("total"), F.sum(F.least("h", "r")).alias("hit"))
    lengths = rows.agg(F.sum(F.size("hyp")).alias("hyp_len"), F.sum(F.size("ref")).alias("ref_len"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("n", "total", "hit"))).alias("c")).crossJoin(lengths)  # two single rows
    start = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("logs"))

    def step(s, x):
        smooth = F.when(x["hit"] == 0, s["smooth"] * 2).otherwise(s["smooth"])
        share = F.when(x["hit"] == 0, 1.0 / (smooth * x["total"])).otherwise(x["hit"] / x["total"])
        return F.struct(smooth.alias("smooth"), (s["logs"] + F.log(share)).alias("logs"))

    logs = F.aggregate("c", start, step)["logs"]
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1.0 - F.col("ref_len") / F.greatest(F.col("hyp_len"), F.lit(1))))
    bleu = F.when(F.size("c") < most, 0.0).otherwise(100.0 * brevity * F.exp(logs / most))
    return one.select(F.coalesce(bleu, F.lit(0.0)).alias("bleu"), brevity.alias("brevity"), F.col("hyp_len"), F.col("ref_len"), F.transform("c", lambda x: x["hit"]).alias("hits"), F.transform("c", lambda x: x["total"]).alias("totals"))
