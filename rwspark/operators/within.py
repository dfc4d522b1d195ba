"""The commit algebra within rows, for scores that are columns of a pair: a function of the prefix i (from 1) and the target word j (from 0).

A pair stays one row from its words to its chunks. Its commits are ``runs``: target words that commit alike, so there are no more runs
than source words. No cell becomes a row, and nothing is grouped, sorted or moved, so a task holds a pair at a time however many
it has. Cells that come as rows (a model's, recorded matrices) go through ``commit``, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rwspark import functions as R

Score = Callable[[Column, Column], Column]


def first_fires(pairs: DataFrame, score: Score, *taus: float, least: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pairs`` (id, n, m and others) with raws: of each target word j and, as at0, at1, ..., of each threshold the first prefix that fires, null for none.

    Prefixes are scored in turn until the threshold fires. Of several thresholds the highest open one is wanted next: a prefix that fires it is
    kept, with its score, until all have fired. ``least``, if given, is a score's lower bound that is cheap to tell: prefixes that can't fire
    what is wanted aren't scored. A NaN is larger than any threshold, so what wasn't evaluated never fires.
    """
    may = lambda i: F.lit(True) if least is None else least(i) < taus[0]

    def word(prefixes: Column, j: Column) -> Column:
        if len(taus) == 1:
            return F.struct(j.alias("j"), F.aggregate(prefixes, F.lit(None).cast("int"), lambda at, i: F.when(at.isNotNull(), at).when(may(i) & (score(i, j) < taus[0]), i)).alias("at0"))

        def step(s: Column, i: Column) -> Column:
            wanted = F.lit(float("-inf"))
            under = lambda d: F.greatest(*(F.when(F.lit(t) <= d, t).otherwise(wanted) for t in taus), wanted)
            lower = lambda d: F.when(d < s["wanted"], F.struct(under(d).alias("wanted"), F.concat(s["lows"], F.array(F.struct(i.alias("i"), d.alias("d")))).alias("lows"))).otherwise(s)
            bound = F.lit(float("-inf")) if least is None else least(i)
            return F.when(bound >= s["wanted"], s).otherwise(R.bound(score(i, j), lower))

        at = lambda s, t: F.get(F.filter(s["lows"], lambda x: x["d"] < t), F.lit(0))["i"]
        none = F.struct(F.lit(float(max(taus))).alias("wanted"), F.array().cast("array<struct<i: int, d: double>>").alias("lows"))
        return F.aggregate(prefixes, none, step, lambda s: F.struct(j.alias("j"), *(at(s, t).alias(f"at{k}") for k, t in enumerate(taus))))

    words = F.sequence(F.lit(0), F.col("m") - 1)
    return pairs.withColumn("raws", R.bound(F.sequence(F.lit(1), F.col("n")), lambda prefixes: F.transform(words, lambda j: word(prefixes, j))))


def runs(raws: Column, at: str = "at0") -> Column:
    """commit, first and last, in order: target words first..last commit at the running maximum of the raw commits, each run at a later one than that before."""

    def step(found: Column, x: Column) -> Column:
        raw = F.coalesce(x[at], F.col("n"))
        highest = F.coalesce(F.get(found, F.size(found) - 1)["commit"], F.lit(0))
        return F.when(raw > highest, F.concat(found, F.array(F.struct(raw.alias("commit"), x["j"].alias("first"))))).otherwise(found)

    finish = lambda found: F.transform(found, lambda x, k: F.struct(x["commit"].alias("commit"), x["first"].alias("first"), (F.coalesce(F.get(found, k + 1)["first"], F.col("m")) - 1).alias("last")))
    return F.aggregate(raws, F.array().cast("array<struct<commit: int, first: int>>"), step, finish)


def fired(raws: Column, at: str = "at0") -> Column:
    return F.size(F.filter(raws, lambda x: x[at].isNotNull())).cast("long")


def traced(pairs: DataFrame, score: Score, tau: float, least: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pairs`` with raws and runs at a threshold."""
    return first_fires(pairs, score, tau, least=least).withColumn("runs", runs(F.col("raws")))


def summary(found: Column) -> Column:
    """chunks, sum_commit, early and the Pearson coefficient of (commit / n, (j + 1) / m), from runs: sums of whole numbers, as places within a run are an arithmetic series."""
    n, m, whole = F.col("n"), F.col("m").cast("long"), lambda x: x.cast("long")
    wide = lambda x: x.cast("decimal(38,0)")  # noqa: E731  (n * n * m * m may be beyond a long)
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in ("x", "xx", "xy")))

    def step(s: Column, r: Column) -> Column:
        size, x = whole(r["last"] - r["first"] + 1), whole(r["commit"])
        return F.struct((s["x"] + x * size).alias("x"), (s["xx"] + x * x * size).alias("xx"), (s["xy"] + x * size * (r["first"] + r["last"] + 2)).alias("xy"))  # xy: twice

    def made(found: Column) -> Column:
        def finish(s: Column) -> Column:
            spread = (wide(m) * wide(s["xx"]) - wide(s["x"]) * wide(s["x"])).cast("double") * (m * m - 1).cast("double") / 3
            pearson = F.when((m >= 2) & (F.size(found) > 1), (s["xy"] - s["x"] * (m + 1)).cast("double") / F.sqrt(spread))
            whole_source = F.get(F.filter(found, lambda r: r["commit"] >= n), F.lit(0))["first"]
            return F.struct(whole(F.size(found)).alias("chunks"), s["x"].alias("sum_commit"), whole(F.coalesce(whole_source, F.col("m"))).alias("early"), pearson.alias("pearson"))

        return F.aggregate(found, zero, step, finish)

    return R.bound(found, made)


def summaries(rows: DataFrame) -> DataFrame:
    """Of rows with raws and runs: id, n, m, chunks, sum_commit, early, fired and pearson, as ``commit.summaries``."""
    one = F.struct(fired(F.col("raws")).alias("fired"), summary(F.col("runs")).alias("s"))
    rows = rows.select("id", "n", "m", F.explode_outer(F.array(one)).alias("r"))  # a filter on what is made here would make it twice, but for this
    return rows.select("id", "n", "m", "r.s.chunks", "r.s.sum_commit", "r.s.early", "r.fired", "r.s.pearson")


def swept(pairs: DataFrame, score: Score, taus: list[float], least: Callable[[Column], Column] | None = None) -> DataFrame:
    """Summaries for each threshold, with rung and tau, as ``commit.swept``: every prefix is scored once at most."""
    raws = F.col("raws")
    rung = lambda k, t: F.struct(F.lit(k).alias("rung"), F.lit(t).alias("tau"), fired(raws, f"at{k}").alias("fired"), summary(runs(raws, f"at{k}")).alias("s"))
    rows = first_fires(pairs, score, *taus, least=least).select("id", "n", "m", F.array(*(rung(k, t) for k, t in enumerate(taus))).alias("rungs"))
    rows = rows.select("id", "n", "m", F.explode_outer("rungs").alias("r"))  # outer: nothing is made once more to see whether it is empty
    return rows.select("id", "r.rung", "r.tau", "n", "m", "r.s.chunks", "r.s.sum_commit", "r.s.early", "r.fired", "r.s.pearson")


def trace(rows: DataFrame) -> DataFrame:
    """Of rows with runs, and raws if they have any: id, n, m, j, commit and chunk (from 1), and raw and fired."""
    own = F.col("run.first"), F.col("run.last")
    out = rows.select("id", "n", "m", *(["raws"] if "raws" in rows.columns else []), F.posexplode_outer("runs").alias("k", "run"))
    some = ["id", "n", "m", F.col("run.commit").alias("commit"), (F.col("k") + 1).cast("long").alias("chunk")]
    if "raws" not in rows.columns:
        return out.select(*some, F.explode_outer(F.sequence(*own)).alias("j"))
    out = out.select(*some, F.explode_outer(F.slice("raws", own[0] + 1, own[1] - own[0] + 1)).alias("x"))
    return out.select("id", "n", "m", F.col("x.j").alias("j"), F.coalesce("x.at0", "n").alias("raw"), F.col("x.at0").isNotNull().alias("fired"), "commit", "chunk")


def snapped(commit: Column, at: Column) -> Column:
    """The first of the boundaries ``at`` (sorted) that is no earlier than a commit, else the whole source."""
    return F.coalesce(F.get(F.filter(at, lambda b: b >= commit), F.lit(0)), F.col("n"))


def chunks(found: Column, at: Column | None = None) -> Column:
    """chunk, start, stop, first and last from runs, as ``commit.chunked``: with boundaries, a run that snaps to where the one before does joins its chunk."""
    stop = lambda r: r["commit"] if at is None else snapped(r["commit"], at)

    def made(own: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            start = F.coalesce(F.get(own, k - 1)["stop"], F.lit(0))
            last = F.coalesce(F.get(own, k + 1)["first"], F.col("m")) - 1
            return F.struct((k + 1).alias("chunk"), start.alias("start"), F.when(k + 1 == F.size(own), F.col("n")).otherwise(x["stop"]).alias("stop"), x["first"].alias("first"), last.alias("last"))

        return F.transform(own, one)

    opening = lambda all: F.filter(all, lambda x, k: x["stop"] > F.coalesce(F.get(all, k - 1)["stop"], F.lit(0)))
    return R.bound(F.transform(found, lambda r: F.struct(stop(r).alias("stop"), r["first"].alias("first"))), lambda all: R.bound(opening(all), made))


def texts(rows: DataFrame, sep: str | Column = " ", target_sep: str | Column | None = None) -> DataFrame:
    """``rows`` (with s, t and chunks) with source_chunks and target_chunks, as ``commit.texts``."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    rows = rows.withColumn("_s", text(sep)).withColumn("_t", text(sep if target_sep is None else target_sep))
    cut = lambda side, first, size, by: F.transform("chunks", lambda c: F.call_function("array_join", F.slice(side, first(c) + 1, size(c)), F.col(by)))
    rows = rows.withColumn("source_chunks", cut("s", lambda c: c["start"], lambda c: c["stop"] - c["start"], "_s"))
    return rows.withColumn("target_chunks", cut("t", lambda c: c["first"], lambda c: c["last"] - c["first"] + 1, "_t")).drop("_s", "_t")


def fired_divergence(rows: DataFrame, score: Score) -> DataFrame:
    """Of rows with runs, as ``commit.fired_divergence``: only the cells at commits are scored once more."""
    at = lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda j: score(r["commit"], j))
    early = F.flatten(F.transform(F.filter("runs", lambda r: r["commit"] < F.col("n")), at))
    here = F.filter(early, lambda d: d.isNotNull() & ~F.isnan(d))
    mean = lambda ds: F.when(F.size(ds) > 0, F.aggregate(ds, F.lit(0.0), lambda s, d: s + d) / F.size(ds))
    one = R.bound(here, lambda ds: F.struct(F.size(ds).cast("long").alias("fired"), mean(ds).alias("divergence")))
    return rows.select("id", F.inline_outer(F.array(one)))
