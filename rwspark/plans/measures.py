"""Queries of latency, policies, divergences, sampling, joins and statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rwspark import functions as R
from rwspark import sources
from rwspark.operators import bleu as bleu_op
from rwspark.operators import commit, latency, sampling, transport

from . import oracle as o

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


# Streaming latency, wait-3.

_WAIT = o.TOKENS + """, steps AS (SELECT id, n, m, i AS commit, row_number() OVER (PARTITION BY id ORDER BY i) AS k, count(*) OVER (PARTITION BY id) AS c
  FROM tokens, LATERAL (SELECT unnest(range(1, n + 1)) AS i) WHERE i % 3 = 0 OR i = n)"""
_LAGS = """, g AS (SELECT id, n, m, c, commit AS g, row_number() OVER (PARTITION BY id ORDER BY k, r) - 1 AS i
  FROM steps, LATERAL (SELECT unnest(range(round_even((k - 1) * m::DOUBLE / c, 0)::INT, round_even(k * m::DOUBLE / c, 0)::INT)) AS r))"""


def _waitk(spark: SparkSession, d: str) -> DataFrame:
    return latency.lags(latency.waitk(sources.short_pairs(spark, d), 3))


@query(_WAIT + " SELECT id, k::INT AS at, commit::INT AS commit FROM steps")
def waitk_trace(spark: SparkSession, d: str) -> DataFrame:
    return latency.waitk(sources.short_pairs(spark, d), 3).select("id", "at", "commit")


@query(_WAIT + _LAGS + " SELECT id, c AS chunks, array_to_string(list(g ORDER BY i), ' ') AS g FROM g GROUP BY id, c")
def lag_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _waitk(spark, d).select("id", "chunks", F.array_join("g", " ").alias("g"))


_AL = """, tau AS (SELECT id, n, m, coalesce(min(i) FILTER (g >= n) + 1, count(*)) AS whole FROM g GROUP BY id, n, m),
al AS (SELECT g.id, avg(g - i * g.n::DOUBLE / g.m) FILTER (i < whole) AS al, avg(g - i * g.n::DOUBLE / g.m) AS laal, avg(g - i * g.n::DOUBLE / greatest(g.m, g.m + g.id % 3)) FILTER (i < whole) AS published FROM g JOIN tau USING (id) GROUP BY g.id)"""


@query(_WAIT + _LAGS + _AL + " SELECT id, round(al, 6) AS al FROM al")
def al(spark: SparkSession, d: str) -> DataFrame:
    return _waitk(spark, d).select("id", F.round(latency.average_lagging(F.col("g"), F.col("n"), F.col("m")), 6).alias("al"))


@query(_WAIT + _LAGS + _AL + " SELECT id, round(laal, 6) AS laal FROM al")
def laal_ref(spark: SparkSession, d: str) -> DataFrame:
    return _waitk(spark, d).select("id", F.round(latency.length_adaptive(F.col("g"), F.col("n"), F.col("m")), 6).alias("laal"))


@query(_WAIT + _LAGS + _AL + " SELECT id, round(published, 6) AS laal FROM al")
def laal_published(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("m") + F.col("id") % 3
    return _waitk(spark, d).select("id", F.round(latency.length_adaptive_published(F.col("g"), F.col("n"), F.col("m"), ref), 6).alias("laal"))


_DAL = """, top AS (SELECT *, greatest(max(g - (i + 1) * n::DOUBLE / m) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), 0e0) AS top FROM g)"""


@query(_WAIT + _LAGS + _DAL + " SELECT id, round(avg((i + 1) * n::DOUBLE / m + top - i * n::DOUBLE / m), 6) AS dal FROM top GROUP BY id")
def dal(spark: SparkSession, d: str) -> DataFrame:
    return latency.differentiable(_waitk(spark, d)).select("id", F.round("dal", 6).alias("dal"))


@query(_WAIT + _LAGS + _AL + " SELECT round(avg(al) + (100e0 / sum(m)) * 3e0 * (avg(m) / 2), 6) AS al_ca FROM al JOIN tokens USING (id)")
def al_ca(spark: SparkSession, d: str) -> DataFrame:
    rows = _waitk(spark, d).withColumn("al", latency.average_lagging(F.col("g"), F.col("n"), F.col("m")))
    one = rows.agg(F.avg("al").alias("al"), F.sum("m").alias("words"), F.avg("m").alias("mean"))
    return one.select(F.round(latency.computation_aware(F.col("al"), F.lit(100.0), F.col("words"), 3.0, F.col("mean")), 6).alias("al_ca"))


@query(_WAIT + _LAGS + _AL + ", lat AS (SELECT id, al, 'medium' AS latency FROM al) SELECT count(*) AS n, round(avg(al), 6) AS mean, round(median(al), 6) AS median, avg(c) > 1.05 AS smoke FROM lat JOIN (SELECT DISTINCT id, c FROM g) USING (id)")
def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = _waitk(spark, d).withColumn("al", latency.average_lagging(F.col("g"), F.col("n"), F.col("m")))
    out = rows.agg(F.count("*").alias("n"), F.round(F.avg("al"), 6).alias("mean"), (F.avg("chunks") > 1.05).alias("smoke"))
    middle = commit.order_statistics(rows.withColumn("run", F.lit(1)), ["run"], "al", lo=commit.lower_median, hi=commit.upper_median)
    return out.crossJoin(middle.select(F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("median")))  # two single rows


# Policies over hashed scores.

_H = lambda tag: o.hashed(f"'{tag}|' || id || '|' || i")
_SCORES = o.TOKENS + f""", scores AS (SELECT id, n, m, i, {_H('eor')} * {_H('eor2')} AS p_eor, 1 + floor({_H('rank')} * 8)::INT AS rank_eor, {_H('other')} AS p_other
  FROM tokens, LATERAL (SELECT unnest(range(1, n + 1)) AS i))"""


def scores(tokens: DataFrame) -> DataFrame:
    """Hashed stand-ins of a model's scores for ending the read after each source word."""
    rows = tokens.select("id", "n", "m", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    h = lambda tag: sources.hashed(F.lit(tag), "id", "i")
    return rows.select("*", (h("eor") * h("eor2")).alias("p_eor"), (1 + F.floor(h("rank") * 8)).cast("int").alias("rank_eor"), h("other").alias("p_other"))


def _drain(fires: str) -> str:
    return _SCORES + f""", fired AS (SELECT *, bool_or({fires}) OVER (PARTITION BY id) AS ever, {fires} AS fires FROM scores)
SELECT id, i::INT AS commit, row_number() OVER (PARTITION BY id ORDER BY i)::INT AS at, NOT ever AS exhausted FROM fired WHERE fires OR i = n"""


def _policy(spark: SparkSession, d: str, name: str, **options) -> DataFrame:
    reads = scores(sources.short_pairs(spark, d)).withColumn("fires", latency.policy(name, **options))
    return latency.drained(reads).select("id", "commit", "at", "exhausted")


@query(_drain("p_eor > 0.10e0"))
def policy_prob(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, "check_prob_thresh", theta=0.10)


@query(_drain("rank_eor <= 3"))
def policy_rank(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, "check_rank", r=3)


@query(_drain("CASE WHEN p_other <= 0 THEN true ELSE p_eor / p_other > 0.5e0 END"))
def policy_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, "check_ratio", ratio=0.5)


@query(_drain("rank_eor = 1"))
def policy_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, "check_argmax")


@query(_drain("i % 3 = 0"))
def policy_waitk(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, "wait_k", k=3)


@query(_SCORES + f""", others AS (SELECT id, i, p_eor, k, {o.hashed("'vocab|' || id || '|' || i || '|' || k")} AS p FROM scores, range(32) x(k))
SELECT id, i::INT AS i, (1 + count(*) FILTER (p > p_eor))::INT AS rank FROM others GROUP BY id, i"""  )
def eor_rank(spark: SparkSession, d: str) -> DataFrame:
    """Of the end of read, among the scores of 32 other tokens."""
    others = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: sources.hashed(F.lit("vocab"), "id", "i", k))
    return scores(sources.short_pairs(spark, d)).select("id", "i", R.rank_of(F.col("p_eor"), others).alias("rank"))


@query(_SCORES + """, pos AS (SELECT *, CASE i WHEN 1 THEN 'w1' WHEN 3 THEN 'w3' ELSE 'later' END AS pos, CASE id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS variant FROM scores)
SELECT pos, round(avg(p_eor) FILTER (variant = 'a'), 6) AS a, round(avg(p_eor) FILTER (variant = 'b'), 6) AS b FROM pos GROUP BY pos""")
def eor_by_position(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(sources.short_pairs(spark, d)).withColumn("pos", F.when(F.col("i") == 1, "w1").when(F.col("i") == 3, "w3").otherwise("later"))
    rows = rows.withColumn("variant", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).groupBy("pos").pivot("variant", ["a", "b"]).agg(F.avg("p_eor"))
    return rows.select("pos", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(_SCORES + " SELECT round(avg(p_eor) FILTER (i % 3 = 0), 6) AS at_commit, round(avg(p_eor) FILTER (i % 3 <> 0), 6) AS elsewhere, round(avg(p_eor) FILTER (i % 3 = 0) / avg(p_eor) FILTER (i % 3 <> 0), 6) AS ratio FROM scores")
def eor_contrast(spark: SparkSession, d: str) -> DataFrame:
    at, off = F.avg(F.when(F.col("i") % 3 == 0, F.col("p_eor"))), F.avg(F.when(F.col("i") % 3 != 0, F.col("p_eor")))
    return scores(sources.short_pairs(spark, d)).agg(F.round(at, 6).alias("at_commit"), F.round(off, 6).alias("elsewhere"), F.round(F.try_divide(at, off), 6).alias("ratio"))


@query(_SCORES + """, three AS (SELECT id, avg(p_eor) AS low, avg(p_other) AS mid, avg(rank_eor / 8e0) AS med FROM scores GROUP BY id)
SELECT round(avg((mid BETWEEN least(low, med) - 0.02e0 AND greatest(low, med) + 0.02e0)::INT), 6) AS within, bool_and(mid BETWEEN 0 AND 1) AS bounded,
round(avg((low - mid) / (low - med)) FILTER (abs(low - med) > 1e-4), 5) AS fraction FROM three""")
def interpolation_check(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(sources.short_pairs(spark, d)).groupBy("id").agg(F.avg("p_eor").alias("low"), F.avg("p_other").alias("mid"), F.avg(F.col("rank_eor") / 8.0).alias("med"))
    inside = F.col("mid").between(F.least("low", "med") - 0.02, F.greatest("low", "med") + 0.02)
    share = F.when(F.abs(F.col("low") - F.col("med")) > 1e-4, (F.col("low") - F.col("mid")) / (F.col("low") - F.col("med")))
    return rows.agg(F.round(F.avg(inside.cast("int")), 6).alias("within"), F.bool_and(F.col("mid").between(0, 1)).alias("bounded"), F.round(F.avg(share), 5).alias("fraction"))


_LOSS = _SCORES + ", loss AS (SELECT *, -ln(greatest(p_other, 1e-12)) AS loss, i % 5 = 0 AS special FROM scores)"


def _losses(spark: SparkSession, d: str) -> DataFrame:
    return scores(sources.short_pairs(spark, d)).select("*", (-F.log(F.greatest("p_other", F.lit(1e-12)))).alias("loss"), (F.col("i") % 5 == 0).alias("special"))


@query(_LOSS + " SELECT special, count(*) AS n, round(avg(loss), 6) AS mean, round(list_sort(list(loss))[1 + count(*) // 2], 6) AS upper_median FROM loss GROUP BY special")
def special_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = _losses(spark, d)
    out = rows.groupBy("special").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean"))
    middle = commit.order_statistics(rows, ["special"], "loss", upper_median=commit.upper_median)
    return out.join(middle, "special").withColumn("upper_median", F.round("upper_median", 6))


@query(_LOSS + " SELECT id, round(sum(loss * CASE WHEN special THEN 5 ELSE 1 END) / sum(CASE WHEN special THEN 5 ELSE 1 END), 6) AS by_weights, round(sum(loss * CASE WHEN special THEN 5 ELSE 1 END) / count(*), 6) AS by_mask FROM loss GROUP BY id")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("special"), 5).otherwise(1)
    total = F.sum(F.col("loss") * weight)
    return _losses(spark, d).groupBy("id").agg(F.round(total / F.sum(weight), 6).alias("by_weights"), F.round(total / F.count("*"), 6).alias("by_mask"))


@query(_LOSS + """, steps AS (SELECT i AS step, avg(loss) AS loss FROM loss GROUP BY i),
best AS (SELECT *, min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps),
waits AS (SELECT *, sum((before IS NULL OR loss < before)::INT) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM best),
stale AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS stale FROM waits)
SELECT (SELECT arg_min(step, loss) FROM steps)::INT AS best_step, (SELECT min(step) FROM stale WHERE stale >= 5)::INT AS stop_step""")
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    steps = _losses(spark, d).groupBy(F.col("i").alias("step")).agg(F.avg("loss").alias("loss"))  # a row for each evaluation
    w = Window.orderBy("step")
    before = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.coalesce((F.col("loss") < before).cast("int"), F.lit(1))
    runs = steps.withColumn("run", better).withColumn("run", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("stale", F.row_number().over(Window.partitionBy("run").orderBy("step")) - 1)
    return runs.agg(F.min_by("step", "loss").alias("best_step"), F.min(F.when(F.col("stale") >= 5, F.col("step"))).alias("stop_step"))


# Divergences of softmaxed embeddings: each vector against the next id's.

_DIST = """raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dist AS (SELECT vec_id, e, list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS p FROM raw),
duo AS (SELECT a.vec_id AS id, a.p AS p, b.p AS q, a.e AS e, b.e AS f FROM dist a JOIN dist b ON b.vec_id = a.vec_id + 1)"""


def _distributions(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("p", R.softmax(F.col("e")))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"), F.col("p").alias("q"))
    return rows.join(after, "vec_id").withColumnRenamed("vec_id", "id")


_CL = lambda x: f"greatest({x}, 1e-12)"


@query(_DIST + f" SELECT id, round(list_sum(list_transform(p, lambda x, i: 0.5e0 * ({_CL('x')} * ln({_CL('x')} / (({_CL('x')} + {_CL('q[i]')}) / 2)) + {_CL('q[i]')} * ln({_CL('q[i]')} / (({_CL('x')} + {_CL('q[i]')}) / 2))))), 8) AS js FROM duo")
def js_div(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("id", F.round(R.criterion("js")(F.col("p"), F.col("q")), 8).alias("js"))


@query(_DIST + f" SELECT id, round(list_sum(list_transform(p, lambda x, i: {_CL('x')} * ln({_CL('x')} / {_CL('q[i]')}))), 8) AS kl FROM duo")
def kl_div(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("id", F.round(R.criterion("kl")(F.col("p"), F.col("q")), 8).alias("kl"))


@query(_DIST + f" SELECT vec_id AS id, round(-list_sum(list_transform(p, lambda x: {_CL('x')} * ln({_CL('x')}))), 8) AS entropy FROM dist")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), R.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    return rows.select("id", F.round(R.entropy(F.col("p")), 8).alias("entropy"))


@query(_DIST + " SELECT id, round(greatest(1 - list_sum(list_transform(e, lambda x, i: x * f[i])) / (greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) * greatest(sqrt(list_sum(list_transform(f, lambda x: x * x))), 1e-12)), 0), 8) AS cost FROM duo")
def cosine_cost(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("id", F.round(R.cosine_cost(F.col("e"), F.col("f")), 8).alias("cost"))


@query(_DIST + ", ranked AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS k FROM dist, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)) SELECT vec_id AS id, array_to_string(list(i - 1 ORDER BY k), ' ') AS top FROM ranked WHERE k <= 8 GROUP BY vec_id")
def topk_support(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), R.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    return rows.select("id", F.array_join(R.top_k(F.col("p"), 8), " ").alias("top"))


@query(_DIST + " SELECT id, round(sqrt(list_sum(list_transform(e, lambda x, i: (x - f[i]) * (x - f[i])))), 6) AS moved FROM duo")
def embedding_movement(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d).select("id", F.round(R.distance(F.col("e"), F.col("f")), 6).alias("moved"))


@query("SELECT label, (i - 1)::INT AS i, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY label, i")
def embedding_average(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# Means of the vectors of a label, as new tokens are started from: with noise, and against the next label's.
_MEANS = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) WHERE label IS NOT NULL GROUP BY label, i)"""


def _means(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "embeddings").filter("label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("mean"))


_NOISE = "sqrt(-2 * ln({a} + 1.1641532182693481e-10)) * cos(6.283185307179586e0 * {b})".format(a=o.hashed("'init|a|' || label || '|' || (i - 1)"), b=o.hashed("'init|b|' || label || '|' || (i - 1)"))


@query(_MEANS + f" SELECT label, (i - 1)::INT AS i, round(mean + 0.01e0 * {_NOISE}, 6) AS start FROM means")
def descriptive_init(spark: SparkSession, d: str) -> DataFrame:
    rows = _means(spark, d)
    return rows.select("label", "i", F.round(F.col("mean") + 0.01 * R.gaussian(sources.hashed(F.lit("init"), F.lit("a"), "label", "i"), sources.hashed(F.lit("init"), F.lit("b"), "label", "i")), 6).alias("start"))


@query(_MEANS + """, labels_in_order AS (SELECT label, lead(label) OVER (ORDER BY label) AS after FROM (SELECT DISTINCT label FROM means))
SELECT l.label, round(sum(a.mean * b.mean) / (greatest(sqrt(sum(a.mean * a.mean)), 1e-12) * greatest(sqrt(sum(b.mean * b.mean)), 1e-12)), 6) AS cosine
FROM labels_in_order l JOIN means a ON a.label = l.label JOIN means b ON b.label = l.after AND b.i = a.i GROUP BY l.label""")
def average_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the mean vectors of neighbouring labels."""
    rows = _means(spark, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "mean")))["mean"].alias("mean"))  # a row a label
    after = rows.withColumn("after", F.lead("mean").over(Window.orderBy("label"))).filter("after IS NOT NULL")
    return after.select("label", F.round(R.cosine(F.col("mean"), F.col("after")), 6).alias("cosine"))


@query(_DIST + " SELECT vec_id AS id, round(ln(list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) + list_max(e) - e[vec_id % len(e) + 1], 8) AS loss FROM dist")
def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Of a vector taken as logits, for a recorded label."""
    rows = sources.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select("id", F.round(R.cross_entropy(F.col("e"), (F.col("id") % F.size("e")).cast("int")), 8).alias("loss"))


@query()
def ot_sinkhorn(spark: SparkSession, d: str) -> DataFrame:
    """Ground cost: 64 fixed vectors on a circle; distributions are the softmaxed embeddings."""
    angle = 2 * np.pi * np.arange(64) / 64
    return transport.costs(_distributions(spark, d).select("id", "p", "q"), np.stack((np.cos(angle), np.sin(angle)), 1), k=128, rounds=200).withColumn("ot", F.round("ot", 5))


# Sampling and splits of documents.

_ORDER = "md5('{s}|' || doc_id), doc_id"
_DOCS = "lat AS (SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS latency FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("doc_id") % 3 == 0, "low").when(F.col("doc_id") % 3 == 1, "medium").otherwise("high")
    return sources.table(spark, d, "documents").select("doc_id", "lang", "source", label.alias("latency"))


@query(_DOCS + f", r AS (SELECT doc_id, latency, row_number() OVER (PARTITION BY latency ORDER BY {_ORDER.format(s='42')}) AS k FROM lat) SELECT doc_id, latency FROM r WHERE k <= CASE latency WHEN 'medium' THEN 34 ELSE 33 END")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced(_docs(spark, d), 100, key="doc_id", seed="42").select("doc_id", "latency")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER.format(s='7')}) AS k FROM documents) WHERE k <= 70")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(_docs(spark, d), "lang", 70, "doc_id", "7", 70).select("doc_id", "lang")


@query(f"SELECT doc_id, direction, row_number() OVER (ORDER BY direction, k) - 1 AS running FROM (SELECT doc_id, lang || '-en' AS direction, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER.format(s='1')}) AS k FROM documents WHERE lang IS NOT NULL AND len(regexp_extract_all(text, '\\S+')) BETWEEN 1 AND 80) WHERE k <= 50")
def direction_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "documents").filter(F.size(sources.words("text")).between(1, 80) & F.col("lang").isNotNull())
    return sampling.direction_quota(rows.select("doc_id", F.concat("lang", F.lit("-en")).alias("direction")), 50, "doc_id", "1").select("doc_id", "direction", "running")


@query("keys AS (SELECT conv_id, row_number() OVER (ORDER BY md5('3|' || conv_id), conv_id) AS k FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, turn, CASE WHEN k <= (SELECT greatest(1, floor(count(*) * 0.05e0)) FROM keys) THEN 'eval' ELSE 'train' END AS split FROM conversations JOIN keys USING (conv_id)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_split(sources.table(spark, d, "conversations").select("conv_id", "turn"), 0.05, "conv_id", "3")


@query("""keys AS (SELECT conv_id, row_number() OVER (ORDER BY md5('3|' || conv_id), conv_id) AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
sides AS (SELECT conv_id, k <= (SELECT greatest(1, floor(count(*) * 0.05e0)) FROM keys) AS held FROM conversations JOIN keys USING (conv_id))
SELECT count(*) AS shared FROM (SELECT conv_id FROM sides WHERE held INTERSECT SELECT conv_id FROM sides WHERE NOT held)""")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    rows = group_split(spark, d)
    return rows.filter("split = 'train'").select("conv_id").intersect(rows.filter("split = 'eval'").select("conv_id")).agg(F.count("*").alias("shared"))


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {_ORDER.format(s='9')} LIMIT 25")
def heldout_probe(spark: SparkSession, d: str) -> DataFrame:
    rest = _docs(spark, d).join(sources.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")
    return rest.orderBy(sampling.ordered("doc_id", "9"), "doc_id").limit(25)


# Joins.


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_index(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).join(sources.table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).join(sources.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, CASE WHEN count(*) FILTER (l.doc_id IS NULL) = 0 THEN 'DONE' ELSE 'NEEDS_RESUME' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def completion_status(spark: SparkSession, d: str) -> DataFrame:
    return sources.completion(_docs(spark, d), sources.table(spark, d, "labels"), "doc_id")


@query("SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality")
def index_join(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).join(sources.table(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("lookup AS (SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS k FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) WHERE k = 1) SELECT d.doc_id, l.doc_id AS last FROM documents d JOIN lookup l USING (lang, source) JOIN labels USING (doc_id)".replace("JOIN labels USING (doc_id)", "WHERE d.doc_id IN (SELECT doc_id FROM labels)"))
def last_wins_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last row of a composite key wins: a grouped maximum, combined before the shuffle, where a window would sort whole groups."""
    rows = _docs(spark, d)
    last = rows.groupBy("lang", "source").agg(F.max("doc_id").alias("last"))
    return rows.join(sources.table(spark, d, "labels"), "doc_id", "left_semi").join(last, ["lang", "source"]).select("doc_id", "last")


@query(r"""SELECT lang AS direction, count(*) AS pool, count(l.doc_id) AS matched, count(*) FILTER (quality = 1) AS snap_ok, count(*) FILTER (quality = 1 AND toxic = 0) AS final
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    labels = sources.table(spark, d, "labels").withColumn("there", F.lit(True))
    rows = _docs(spark, d).join(labels, "doc_id", "left")
    return rows.groupBy(F.col("lang").alias("direction")).agg(
        F.count("*").alias("pool"), F.count("there").alias("matched"), F.count_if(F.col("quality") == 1).alias("snap_ok"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("final")
    )


@query("""grid AS (SELECT n_nationkey, n_name, p FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders)),
cells AS (SELECT c_nationkey, o_orderpriority, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT n_name, p AS priority, orders FROM grid LEFT JOIN cells ON n_nationkey = c_nationkey AND p = o_orderpriority""")
def grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A grid of conditions with their results, null where there is none: the grid is a product of two small sets of names."""
    orders = sources.table(spark, d, "orders")
    grid = sources.table(spark, d, "nation").select("n_nationkey", "n_name").crossJoin(F.broadcast(orders.select(F.col("o_orderpriority").alias("priority")).distinct()))
    found = orders.filter("o_orderstatus = 'P'").join(sources.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = found.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))
    return grid.join(found, ["n_nationkey", "priority"], "left").select("n_name", "priority", "orders")


@query("SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)".replace("UNION ALL", "UNION"))
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    labels = sources.table(spark, d, "labels")
    good, toxic = labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 1").select("doc_id")
    return good.union(toxic).distinct().subtract(toxic)


@query("""gold AS (SELECT id, n, m, j, k, least(n, 1 + ((j * 7 + id + k) % n))::INT AS i FROM tokens, LATERAL (SELECT unnest(range(0, m)) AS j), range(2) x(k)),
a AS (SELECT id, n, m, j, max(i) AS a FROM gold GROUP BY ALL) SELECT id, round(avg((a <= ceil((j + 1) * n::DOUBLE / m))::INT), 6) AS satisfied FROM a GROUP BY id""".join(["WITH " + o.TOKENS + ", ", ""]))
def gold_satisfaction(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.short_pairs(spark, d).select("id", "n", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = rows.withColumn("i", F.least(F.col("n"), 1 + (F.col("j") * 7 + F.col("id") + F.col("k")) % F.col("n")))
    rows = rows.groupBy("id", "n", "m", "j").agg(F.max("i").alias("a"))
    return rows.groupBy("id").agg(F.round(F.avg((F.col("a") <= F.ceil((F.col("j") + 1) * F.col("n").cast("double") / F.col("m"))).cast("int")), 6).alias("satisfied"))


# Statistics.


@query("""SELECT lang, count(*) AS n, round(exp(least(sum(n_chars / 7e0) / greatest(sum(n_chars / 5e0), 1), 20)), 6) AS ppl,
CASE WHEN exp(least(sum(n_chars / 7e0) / greatest(sum(n_chars / 5e0), 1), 20)) < 10 THEN 'good' WHEN exp(least(sum(n_chars / 7e0) / greatest(sum(n_chars / 5e0), 1), 20)) < 30 THEN 'fair' WHEN exp(least(sum(n_chars / 7e0) / greatest(sum(n_chars / 5e0), 1), 20)) < 100 THEN 'weak' ELSE 'bad' END AS verdict FROM documents GROUP BY lang""")
def ppl_by_group(spark: SparkSession, d: str) -> DataFrame:
    ppl = F.exp(F.least(F.sum(F.col("n_chars") / 7.0) / F.greatest(F.sum(F.col("n_chars") / 5.0), F.lit(1.0)), F.lit(20.0)))
    verdict = F.when(ppl < 10, "good").when(ppl < 30, "fair").when(ppl < 100, "weak").otherwise("bad")
    return sources.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(ppl, 6).alias("ppl"), verdict.alias("verdict"))


@query("""SELECT coalesce(lang, '?') AS lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[1 + count(n_chars) // 2] AS upper_median, min(n_chars) AS lo, max(n_chars) AS hi,
list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[1 + floor(count(n_chars) * 0.9e0)::INT] AS p90, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[1 + round_even(0.9e0 * (count(n_chars) - 1), 0)::INT] AS p90_rounded FROM documents GROUP BY coalesce(lang, '?')""")
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), "n_chars")
    x = F.col("n_chars")
    out = rows.groupBy("lang").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    ranks = dict(upper_median=commit.upper_median, lower=commit.lower_median, p90=commit.index_quantile(0.9), p90_rounded=commit.rounded_quantile(0.9))
    out = out.join(commit.order_statistics(rows, ["lang"], "n_chars", **ranks), "lang", "left")
    return out.withColumn("median", (F.col("lower") + F.col("upper_median")) / 2).drop("lower")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))


def _13a(text: str) -> str:
    for name, mark in (("<skipped>", ""), ("-' || chr(10) || '", ""), ("' || chr(10) || '", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{name}', '{mark}')"
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"regexp_extract_all({text}, '\\S+')"


_BLEU = o.PAIRS + f""",
sides AS (SELECT id, {_13a("array_to_string(list_filter(string_split(target, ' '), lambda w, i: (i - 1) % 10 <> 9), ' ')")} AS hyp, {_13a("target")} AS ref FROM pairs),
grams AS (SELECT id, n, array_to_string(hyp[i : i + n - 1], ' ') AS gram, 1 AS h, 0 AS r FROM sides, range(1, 5) x(n), LATERAL (SELECT unnest(range(1, len(hyp) - n + 2)) AS i)
  UNION ALL SELECT id, n, array_to_string(ref[i : i + n - 1], ' '), 0, 1 FROM sides, range(1, 5) x(n), LATERAL (SELECT unnest(range(1, len(ref) - n + 2)) AS i)),
clipped AS (SELECT id, n, gram, sum(h) AS h, least(sum(h), sum(r)) AS hit FROM grams GROUP BY id, n, gram),
counts AS (SELECT n, sum(h)::BIGINT AS total, sum(hit)::BIGINT AS hit FROM clipped GROUP BY n),
lens AS (SELECT sum(len(hyp))::BIGINT AS hyp_len, sum(len(ref))::BIGINT AS ref_len, least(1e0, exp(1e0 - sum(len(ref))::DOUBLE / sum(len(hyp)))) AS b FROM sides)
SELECT round(100 * b * exp(l), 6) AS bleu, round(b, 6) AS brevity, hyp_len, ref_len, hits, totals
FROM lens, (SELECT avg(ln(hit::DOUBLE / total)) AS l, string_agg(hit::VARCHAR, ' ' ORDER BY n) AS hits, string_agg(total::VARCHAR, ' ' ORDER BY n) AS totals FROM counts)"""


@query(_BLEU)
def bleu(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns against a copy that lacks every tenth word."""
    rows = sources.pairs(spark, d).select("id", F.col("target").alias("ref"))
    kept = F.filter(F.split("ref", " "), lambda w, i: i % 10 != 9)
    found = bleu_op.corpus(rows.withColumn("hyp", F.array_join(kept, " ")))
    return found.select(F.round("bleu", 6).alias("bleu"), F.round("brevity", 6).alias("brevity"), "hyp_len", "ref_len", F.array_join("hits", " ").alias("hits"), F.array_join("totals", " ").alias("totals"))
