"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

DataFrame functions only. Each text gives counts, and these a vector of transformed statistics: log mean word length, and
square roots of the shares of symbols, of repeated lines and of repeated word windows. Per group of language and source,
concentration steps start from three fixed estimates (medians and interquartile ranges, all rows, and the rows that lie
closest to the medians) and narrow mean and covariance to the three quarters of rows that lie closest, as long as the
determinant falls. The start that ends with the least determinant is taken for each group, a reweighting step ends it, and
rows whose squared Mahalanobis distance is beyond a chi-square quantile are rejected.

Most texts have no symbols and repeat nothing, so that the least determinant would be zero: squared floors are added to the
variances (a regularised estimate). They also say how small a difference can never reject a text; each statistic alone can
reject one: a tenth of symbols, a third of repeated lines or windows are enough in a group that has none. Quantiles of a group
come from counts in fixed bins, so every step is one aggregation with partial sums; a group that holds a third of all rows
costs no task more than another. Groups under ``least`` rows are pooled by language, these again over all.

Null and empty texts have no words and fail the base rules, as do short ones; they take no part in the estimates. Null
languages and sources are groups of their own. Repeated rows are judged alike and all count. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, attach, free_names, scratch, written

P = 4
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns, the five counts of NAMES, n_lines and base_failed of each text.

    Repeats are found within the row: hashes of the 3-word windows carry their position in the low bits, so that sorting
    them puts equal windows side by side; neighbours are then compared by their words.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    frame = docs.select(*keep, F.col(text_col).alias("_text"))
    frame = frame.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).alias("_words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    word = lambda i: F.get("_words", i)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    frame = frame.select(
        *keep,
        "_words",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        hashes.alias("_hashes"),
    )
    frame = frame.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    bits = F.length(F.bin(F.col("n_words")))
    left = lambda x: F.call_function("shiftleft", x, bits)
    right = lambda x: F.call_function("shiftrightunsigned", x, bits)
    packed = F.sort_array(F.transform("_hashes", lambda h, i: left(h).bitwiseOR(i.cast("long"))))
    frame = frame.withColumn("_sorted", F.when(F.col("_repeats"), packed))
    place = lambda x: (x - left(right(x))).cast("int")

    def same(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        words = (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))
        return F.when(right(x) == right(y), words).otherwise(False)

    found = F.filter("_sorted", lambda x, j: F.coalesce(same(x, F.get("_sorted", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_sorted", j + 1)), F.lit(False)))
    frame = frame.withColumn("_at", F.when(F.col("_repeats"), F.sort_array(F.transform(found, place))))
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    repeated = F.when(F.col("_repeats") & (F.size("_at") > 0), F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return frame.select(*keep, *NAMES[:4], repeated.cast("long").alias("n_repeat_words"), "n_lines").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics; all lie in bounded ranges."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def labelled(rows: DataFrame, least: int) -> DataFrame:
    """Rows with group ``g``: language and source, or pooled where these have under ``least`` rows."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    rows = rows.withColumn("_l", name("lang")).withColumn("_s", name("source"))
    fine = rows.filter(~F.col("base_failed")).groupBy("_l", "_s").count()
    every = rows.select("_l", "_s").distinct().join(fine, ["_l", "_s"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    small = F.when(F.col("count") < least, F.col("count")).otherwise(0)
    pooled = every.join(every.groupBy("_l").agg(F.sum(small).alias("rest")), "_l")
    g = F.when(F.col("count") >= least, F.concat("_l", F.lit("|"), "_s")).when(F.col("rest") >= least, F.concat("_l", F.lit("|*"))).otherwise(F.lit("*"))
    return attach(rows, written(pooled.select("_l", "_s", g.alias("g")), "groups"), ["_l", "_s"])


def _below(bins: DataFrame, by: list[str], bin_col: str) -> DataFrame:
    """With ``before``, rows in lower bins, and ``total`` of the group; a group has a bounded number of bins."""
    w = Window.partitionBy(*by)
    return bins.withColumn("before", F.sum("n").over(w.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).withColumn("total", F.sum("n").over(w))


def start(rows: DataFrame, floors: list[float], grain: int = 256) -> DataFrame:
    """Medians and interquartile ranges of each group, as a first mean and covariance."""
    long = rows.select("g", F.posexplode(F.array(*(F.floor(F.col(f"x{i}") * grain) for i in range(P)))).alias("k", "bin"))
    bins = _below(long.groupBy("g", "k", "bin").agg(F.count("*").alias("n")), ["g", "k"], "bin")
    at = lambda q, k: F.max(F.when((F.col("k") == k) & (F.col("before") < q * F.col("total")), (F.col("bin") + 0.5) / grain))
    found = bins.groupBy("g").agg(*(at(0.5, k).alias(f"m{k}") for k in range(P)), *((at(0.75, k) - at(0.25, k)).alias(f"r{k}") for k in range(P)))
    return found.select("g", *(f"m{k}" for k in range(P)), *(F.lit(0.0).alias(f"c{i}{j}") if i != j else (F.pow(F.col(f"r{i}") / 1.349, 2) + floors[i] ** 2).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))


def cholesky(groups: DataFrame) -> DataFrame:
    """The group's lower triangle l of c = l l', entry by entry."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(P):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return groups.select("g", *(f"m{k}" for k in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)), det.alias("det"))


def distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with ``d2``, the squared Mahalanobis distance to their group, by forward substitution."""
    keep = rows.columns
    rows = attach(rows, groups.drop("det", "falls"), ["g"])
    for i in range(P):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return rows.select(*keep, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0")).alias("d2"))


def _chi2(x: float, df: int) -> float:
    """Distribution function, for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    while hi - lo > 1e-10:
        lo, hi = (lo, mid) if _chi2(mid := (lo + hi) / 2, df) > q else (mid, hi)
    return lo


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def _estimate(sums: DataFrame, floors: list[float], scale: float) -> DataFrame:
    means = sums.select("g", "n", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *(f"q{i}{j}" for i in range(P) for j in range(i + 1)))
    cov = lambda i, j: (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
    return means.select("g", *(f"m{i}" for i in range(P)), *((F.greatest(cov(i, j), F.lit(0.0)) + floors[i] ** 2 if i == j else cov(i, j)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))


def concentrated(rows: DataFrame, groups: DataFrame, floors: list[float], share: float, grain: int = 64) -> DataFrame:
    """One concentration step: moments of the ``share`` of a group's rows that lie closest, to whole bins of distance."""
    binned = distances(rows, groups).withColumn("bin", F.floor(F.least(F.log1p("d2"), F.lit(40.0)) * grain))
    bins = _below(_moments(binned, ["g", "bin"]), ["g"], "bin").filter(F.col("before") < share * F.col("total"))
    names = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i in range(P) for j in range(i + 1)]
    return _estimate(bins.groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)), floors, share / _chi2(_quantile(share, P), P + 2))


def started(fit: DataFrame, floors: list[float]) -> DataFrame:
    """Estimates to start from, three for each group; their number is behind the group's name."""
    near = start(fit, floors)
    close = distances(fit, written(cholesky(near), "mcd")).filter(F.col("d2") <= _quantile(0.5, P))
    every = [near, _estimate(_moments(fit, ["g"]), floors, 1.0), _estimate(_moments(close, ["g"]), floors, 1.0)]
    named = [x.withColumn("g", F.concat("g", F.lit(f"#{k}"))) for k, x in enumerate(every)]
    return written(cholesky(named[0].unionByName(named[1]).unionByName(named[2])), "mcd")


def least_determinant(fit: DataFrame, floors: list[float], share: float, steps: int) -> DataFrame:
    """The estimate of each group with the least determinant that concentration reaches from any of its starts.

    A step is kept where it lowers the determinant; the search ends when it lowers none, or after ``steps``. Ties go to the
    first start.
    """
    dealt = fit.withColumn("k", F.explode(F.array(*(F.lit(f"#{k}") for k in range(STARTS))))).withColumn("g", F.concat("g", "k")).drop("k")
    best = written(cholesky(concentrated(dealt, started(fit, floors), floors, share)), "mcd")
    rest = [c for c in best.columns if c != "g"]
    for _ in range(steps - 1):
        new = cholesky(concentrated(dealt, best, floors, share))
        both = best.select("g", *(F.col(c).alias(f"old_{c}") for c in rest)).join(new, "g")
        falls = F.col("det") < F.col("old_det") * (1 - 1e-9)
        best = written(both.select("g", *(F.when(falls, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in rest), falls.alias("falls")), "mcd")
        if not best.agg(F.bool_or("falls")).first()[0]:
            break
    name = F.regexp_extract("g", r"(?s)^(.*)#(\d+)$", 1)
    chosen = best.groupBy(name.alias("name")).agg(F.min_by(F.struct(*rest), F.struct("det", "g")).alias("e"))
    return written(chosen.select(F.col("name").alias("g"), "e.*"), "mcd")


STARTS = 3
#: Standard deviations added to those of the vector: of log word length, and of the roots of the three shares.
FLOORS = (0.1, 0.06, 0.12, 0.12)
#: Share of ordinary texts that may lie beyond the cutoff.
TAIL = 1e-4


def judged(stats: DataFrame, tail: float = TAIL, share: float = 0.75, steps: int = 20, floors: tuple[float, ...] = FLOORS, least: int = 200) -> DataFrame:
    """``stats`` (a written table with lang and source) with ``distance`` and ``kept``."""
    keep, floors = stats.columns, list(floors)
    for i, x in enumerate(vector()):
        stats = stats.withColumn(f"x{i}", x)
    rows = labelled(stats, least)
    fit = rows.filter(~F.col("base_failed")).select("g", *(f"x{i}" for i in range(P)))
    fit = written(fit, "fit")
    with scratch() as made:
        groups = least_determinant(fit, floors, share, steps)
        made.remove(groups)
    inner = distances(fit, groups).filter(F.col("d2") <= _quantile(0.975, P))
    groups = written(cholesky(_estimate(_moments(inner, ["g"]), floors, 1.0)), "mcd")
    good = distances(rows.filter(~F.col("base_failed")).select(*keep, "g", *(f"x{i}" for i in range(P))), groups)
    good = good.select(*keep, F.sqrt("d2").alias("distance"), (F.col("d2") <= _quantile(1 - tail, P)).alias("kept"))
    return good.unionByName(stats.filter("base_failed").select(*keep, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep`` columns of each row, the counts, base_failed, distance and kept. A kept column that has a name of the result has ``kept_`` put in front; all other names are free."""
    names = free_names(keep, (*NAMES, "n_lines", "base_failed", "distance", "kept"))
    rows = docs.select(F.struct(*(F.col(c).alias(n) for n, c in zip(names, keep))).alias("_row"), "lang", "source", "text")
    stats = written(statistics(rows, ("_row", "lang", "source")), "statistics")
    return judged(stats, **options).select("_row.*", *NAMES, "n_lines", "base_failed", "distance", "kept")
