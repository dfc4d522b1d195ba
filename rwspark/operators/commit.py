"""The commit algebra over cells: first fire, monotone commits, chunk counts, sweeps and ladders.

All steps of a pair stay in its partition: pairs are dealt by id before they become cells, and aggregates and windows reuse
that. Cells from elsewhere are combined (to a row for each target word) before they are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fires(tau: Column | float, d: str = "d") -> Column:
    """Below the threshold; a cell that wasn't evaluated (NaN) never fires."""
    return ~F.isnan(d) & (F.col(d) < tau)


def first_fire(cells: DataFrame, tau: Column | float, by: tuple[str, ...] = (), d: str = "d") -> DataFrame:
    """raw, the first prefix that fires for each target word, else the whole source; fired says whether any did."""
    at = F.min(F.when(fires(tau, d), F.col("i")))
    return cells.groupBy("id", *by, "n", "m", "j").agg(F.coalesce(at, F.col("n")).alias("raw"), at.isNotNull().alias("fired"))


def monotone(commits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """commit, the running maximum of raw."""
    w = Window.partitionBy("id", *by).orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return commits.withColumn("commit", F.max("raw").over(w))


def grouped(commits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk (from 1): runs of equal commits."""
    w = Window.partitionBy("id", *by).orderBy("j")
    new = F.coalesce((F.col("commit") != F.lag("commit").over(w)).cast("int"), F.lit(1))
    return commits.withColumn("new", new).withColumn("chunk", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")


def traces(cells: DataFrame, tau: Column | float, by: tuple[str, ...] = (), d: str = "d") -> DataFrame:
    return grouped(monotone(first_fire(cells, tau, by, d), by), by)


def pearson_sums(x: Column, y: Column, same: Column) -> Column:
    """Pearson's coefficient in an aggregation; null for under two rows or where ``same`` says that x doesn't vary."""
    n = F.count(F.lit(1))
    cov = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return F.when((n >= 2) & ~same, cov / F.sqrt(vx * vy))


def summaries(trace: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each pair: n, m, chunks, sum_commit, committed and fired counts, and the Pearson coefficient of (commit / n, (j + 1) / m)."""
    x, y = F.col("commit").cast("double") / F.col("n"), (F.col("j") + 1).cast("double") / F.col("m")
    return trace.groupBy("id", *by, "n", "m").agg(
        F.max("chunk").cast("long").alias("chunks"),
        F.sum("commit").cast("long").alias("sum_commit"),
        F.sum((F.col("commit") < F.col("n")).cast("long")).alias("early"),
        F.sum(F.col("fired").cast("long")).alias("fired"),
        pearson_sums(x, y, F.min("commit") == F.max("commit")).alias("pearson"),
    )


def swept(cells: DataFrame, taus: list[float]) -> DataFrame:
    """Summaries for each threshold: one aggregation finds the first fires of all thresholds, then these become rows."""
    at = cells.groupBy("id", "n", "m", "j").agg(*(F.min(F.when(fires(t), F.col("i"))).alias(f"at{k}") for k, t in enumerate(taus)))
    rungs = F.explode(F.array(*(F.struct(F.lit(k).alias("rung"), F.lit(t).alias("tau"), F.col(f"at{k}").alias("at")) for k, t in enumerate(taus)))).alias("t")
    rows = at.select("id", "n", "m", "j", rungs).select("id", "t.rung", "t.tau", "n", "m", "j", F.coalesce("t.at", "n").alias("raw"), F.col("t.at").isNotNull().alias("fired"))
    by = ("rung", "tau")
    return summaries(grouped(monotone(rows, by), by), by)


def ladder(sweep: DataFrame, by: str = "id") -> DataFrame:
    """The first rung with over one chunk, else the last one, with fell_back: a rung over the primary was used."""
    w = Window.partitionBy(by)
    good = F.min(F.when(F.col("chunks") > 1, F.col("rung"))).over(w)
    rows = sweep.withColumn("pick", F.coalesce(good, F.max("rung").over(w))).withColumn("solved", good.isNotNull())
    return rows.filter("rung = pick").select(by, "n", "m", F.col("tau").alias("tau_used"), (~F.col("solved") | (F.col("rung") > 0)).alias("fell_back"), "chunks", "sum_commit")


def fired_divergence(cells: DataFrame, tau: Column | float) -> DataFrame:
    """For each pair, how many target words commit before the whole source, with a cell that was evaluated there, and the mean divergence of these cells (null for none)."""
    at = F.coalesce(F.min(F.when(fires(tau), F.col("i"))), F.col("n"))
    rows = monotone(cells.groupBy("id", "n", "m", "j").agg(at.alias("raw"), F.collect_list(F.struct("i", "d")).alias("ds")))
    d = F.get(F.filter("ds", lambda x: x["i"] == F.col("commit")), F.lit(0))["d"]
    rows = rows.withColumn("here", F.when((F.col("commit") < F.col("n")) & ~F.isnan(d), d))
    return rows.groupBy("id").agg(F.count("here").alias("fired"), F.avg("here").alias("divergence"))


def rungs(primary: float, fallbacks: list[float]) -> list[float]:
    return [primary, *sorted(t for t in fallbacks if t > primary)]


def matched(sweep: DataFrame, target: DataFrame) -> DataFrame:
    """The threshold whose chunk count is closest to ``target`` (id, want); ties go to the first."""
    delta = F.abs(F.col("chunks") - F.col("want"))
    best = F.min_by(F.struct("tau", "chunks", "pearson"), F.struct(delta, F.col("rung")))
    return sweep.join(target, "id").groupBy("id", "want").agg(best.alias("b"), F.min(delta).alias("delta")).select("id", "want", F.col("b.tau").alias("tau"), F.col("b.chunks").alias("chunks"), F.col("b.pearson").alias("pearson"), "delta")


#: Ranks (from 0) among ``n`` sorted values: the upper median, the value at int(n * p), that at round(p * (n - 1)) with halves to even.
def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def lower_median(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def index_quantile(p: float):
    return lambda n: F.floor(n * F.lit(p))


def rounded_quantile(p: float):
    return lambda n: F.bround(F.lit(p) * (n - 1))


def _bar(value: Column) -> Column:
    """The bar of a histogram that a value falls into, by ascending values: bars of 1/4096 of the value's size, so there is a fixed number of them."""
    return F.floor(F.asinh(value.cast("double") * 1e6) * 4096)


def order_statistics(rows: DataFrame, by: list[str], value: str, **ranks) -> DataFrame:
    """``by`` and, under each name, the finite value at a rank: a function of the group's count, as those above.

    Equal values are counted before the shuffle. Sums over the bars of a group's histogram tell which bar holds a rank, and only values
    of such bars are put in order, each bar on its own: no task has all values of a group. A group without finite values has no row.
    """
    some = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = some.groupBy(*by, value).agg(F.count("*").alias("_c")).withColumn("_b", _bar(F.col(value)))
    bars = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_h"))
    w = Window.partitionBy(*by)
    running = lambda c, v, key: F.sum(c).over(v.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    bars = bars.withColumn("_under", running("_h", w, "_b")).withColumn("_n", F.sum("_h").over(w))
    holds = lambda rank, low, size: (F.col(low) <= rank(F.col("_n"))) & (rank(F.col("_n")) < F.col(low) + F.col(size))
    held = F.lit(False)
    for rank in ranks.values():
        held = held | holds(rank, "_under", "_h")
    keys = [*by, "_b"]
    bars = bars.filter(held).select(*(F.col(c).alias(f"_of_{c}") for c in keys), "_under", "_n")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inner = counts.join(bars, same).withColumn("_low", F.col("_under") + running("_c", Window.partitionBy(*keys), value))
    return inner.groupBy(*by).agg(*(F.max(F.when(holds(rank, "_low", "_c"), F.col(value))).alias(name) for name, rank in ranks.items()))


def bin_for(pearson: Column, high: float = 0.90, low: float = 0.70) -> Column:
    return F.when(pearson.isNull() | F.isnan(pearson), "undefined").when(pearson >= high, "monotone").when(pearson < low, "reordering").otherwise("mild")


def summarised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, (upper) median, min and max of the finite values; a group without any has n of 0 and nulls."""
    x = F.when(~F.isnan(value), F.col(value))
    out = rows.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.min(x), 6).alias("min"), F.round(F.max(x), 6).alias("max"))
    return out.join(order_statistics(rows, by, value, median=upper_median), by, "left").withColumn("median", F.round("median", 6))


def skipped(rows: DataFrame, bins: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with bin and reason: used, undefined, or missing where there is no bin."""
    found = rows.join(bins.select(key, "bin"), key, "left")
    return found.withColumn("reason", F.when(F.col("bin").isNull(), "missing").when(F.col("bin") == "undefined", "undefined").otherwise("used"))


def chunked(trace: DataFrame, tokens: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Chunks of source and target words from commits: id, chunk, start, stop (source words start..stop-1), first, last (target words).

    With ``boundaries`` (id, at: sorted array), a commit snaps forward to the next of them, or to n. A group whose snapped
    commit is no later than one before it joins the chunk before; the last chunk takes the rest of the source.
    """
    by_commit = trace.groupBy("id", "n", "commit").agg(F.min("j").alias("first"), F.max("j").alias("last"))
    if boundaries is not None:
        by_commit = by_commit.join(boundaries, "id", "left")
        by_commit = by_commit.withColumn("stop", F.coalesce(F.get(F.filter("at", lambda b: b >= F.col("commit")), F.lit(0)), F.col("n"))).drop("at")
    else:
        by_commit = by_commit.withColumn("stop", F.col("commit"))
    w = Window.partitionBy("id").orderBy("first")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("stop") > F.coalesce(before, F.lit(0))).cast("int")
    runs = by_commit.withColumn("chunk", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = runs.groupBy("id", "n", "chunk").agg(F.max("stop").alias("stop"), F.min("first").alias("first"), F.max("last").alias("last"))
    v = Window.partitionBy("id").orderBy("chunk")
    ends = ends.withColumn("start", F.coalesce(F.lag("stop").over(v), F.lit(0)))
    return ends.withColumn("stop", F.when(F.lead("stop").over(v).isNull(), F.col("n")).otherwise(F.col("stop"))).select("id", F.col("chunk").cast("int").alias("chunk"), "start", "stop", "first", "last")


def texts(chunks: DataFrame, tokens: DataFrame, sep: str | Column = " ", target_sep: str | Column | None = None) -> DataFrame:
    """id, source_chunks and target_chunks of each pair. What joins words may differ by side, and by row: columns of ``tokens`` (as ``functions.joint`` of its language)."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    sides = tokens.select("id", "s", "t", text(sep).alias("_s"), text(sep if target_sep is None else target_sep).alias("_t"))
    rows = chunks.join(sides, "id")
    join = lambda side, start, n, by: F.call_function("array_join", F.slice(side, start + 1, n), F.col(by))
    one = F.struct("chunk", join("s", F.col("start"), F.col("stop") - F.col("start"), "_s").alias("src"), join("t", F.col("first"), F.col("last") - F.col("first") + 1, "_t").alias("tgt"))
    rows = rows.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return rows.select("id", F.col("c.src").alias("source_chunks"), F.col("c.tgt").alias("target_chunks"))
