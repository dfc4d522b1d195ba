"""Queries of streaming, annotation and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rwspark import functions as R
from rwspark import sources, streaming
from rwspark.operators import annotate as annotation
from rwspark.operators import latency, sampling

from . import oracle as o
from .corpus import _WITH_LATENCY, _rows
from .measures import _drain, scores

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


@query(_drain("rank_eor <= 3"))
def stream_policy_stateful(spark: SparkSession, d: str) -> DataFrame:
    reads = scores(sources.short_pairs(spark, d)).withColumn("fires", latency.policy("check_rank", r=3))
    return streaming.replayed(reads)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = streaming.activity(sources.table(spark, d, "events"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


_PREFIX = o.TOKENS + """, flat AS (SELECT id, n, m, p, s[p] AS w FROM tokens, LATERAL (SELECT unnest(range(1, n + 1)) AS p)),
vocab AS (SELECT id, n, m, w, count(*) AS freq, count(*) OVER (PARTITION BY id) AS v FROM flat GROUP BY id, n, m, w),
grid AS (SELECT vocab.*, i, (SELECT count(*) FROM flat f WHERE f.id = vocab.id AND f.w = vocab.w AND f.p <= i) AS seen FROM vocab, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
pq AS (SELECT id, i, (seen + 0.1e0) / (i + 0.1e0 * v) AS p, (freq + 0.1e0) / (n + 0.1e0 * v) AS q FROM grid)
SELECT id, i::INT AS i, round(sum(0.5e0 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))), 6) + 0e0 AS js, round(sum(q * ln(q / p)), 6) + 0e0 AS kl, round(-sum(p * ln(p)), 6) AS entropy FROM pq GROUP BY id, i"""


@query(_PREFIX)
def prefix_divergence(spark: SparkSession, d: str) -> DataFrame:
    rows = annotation.prefix_divergence(sources.short_pairs(spark, d))
    return rows.select("id", "i", (F.round("js", 6) + 0.0).alias("js"), (F.round("kl", 6) + 0.0).alias("kl"), F.round("entropy", 6).alias("entropy"))


# The divergence is the same for all target words, so they all commit at once.
_ONCE = _PREFIX[: _PREFIX.rindex("SELECT id, i::INT")] + """, divs AS (SELECT id, i, sum(0.5e0 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))) AS js FROM pq GROUP BY id, i),
raw AS (SELECT t.id, n, m, s, coalesce(min(i) FILTER (js < 0.05e0), n) AS commit FROM tokens t JOIN divs USING (id) GROUP BY t.id, n, m, s)
SELECT id, n, m, 1::BIGINT AS chunks, (commit * m)::BIGINT AS sum_commit, array_to_string(s, ' ') AS source_chunks FROM raw"""


@query(_ONCE)
def annotate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prefix word distributions as the scorer, every prefix."""
    rows = annotation.annotate(sources.short_pairs(spark, d), "prefix", tau=0.05)
    return rows.select("id", "n", "m", "chunks", "sum_commit", F.array_join("source_chunks", "|").alias("source_chunks"))


@query()
def annotate_transport(spark: SparkSession, d: str) -> DataFrame:
    """As annotate_pairs, by the transport cost between the distributions."""
    rows = annotation.annotate(sources.token_pairs(spark, d), "prefix", tau=0.05, criterion="ot")
    return rows.select("id", "n", "m", "chunks", "sum_commit", F.array_join("source_chunks", "|").alias("source_chunks"))


@query(_WITH_LATENCY + """ SELECT latency, count(*) AS rows, round(avg(k), 6) AS chunks, round(avg(k::DOUBLE / list_sum(sizes)), 6) AS chunks_per_word, count(*) FILTER (k = 1) AS single FROM rows GROUP BY latency""")
def latency_diag(spark: SparkSession, d: str) -> DataFrame:
    words = F.aggregate("sizes", F.lit(0), lambda s, x: s + x)
    rows = _rows(spark, d).select("latency", F.size("sizes").alias("k"), words.alias("words"))
    return rows.groupBy("latency").agg(F.count("*").alias("rows"), F.round(F.avg("k"), 6).alias("chunks"), F.round(F.avg(F.col("k") / F.col("words")), 6).alias("chunks_per_word"), F.count_if(F.col("k") == 1).alias("single"))


_MARKS = "regexp_extract_all('<|' || latency || '-latency|> ' || array_to_string(list_transform(src, lambda x, i: x || ' <|end-of-read|> ' || tgt[i] || ' <|end-of-write|>'), ' '), '<\\|end-of-(read|write)\\|>', 1)"


@query(_WITH_LATENCY + f""", marked AS (SELECT id, {_MARKS} AS marks FROM rows)
SELECT id, len(list_filter(marks, lambda x: x = 'read'))::BIGINT AS reads, len(list_filter(marks, lambda x: x = 'write'))::BIGINT AS writes,
  len(list_filter(marks, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'read' ELSE 'write' END)) = 0 AS alternate FROM marked""")
def format_check(spark: SparkSession, d: str) -> DataFrame:
    """Marks in the interleaved text: as many reads as writes, in turn."""
    text = R.interleaved(F.col("latency"), F.col("source_chunks"), F.col("target_chunks"))
    marks = F.regexp_extract_all(text, F.lit(r"<\|end-of-(read|write)\|>"), F.lit(1))
    rows = _rows(spark, d).select("id", marks.alias("marks"))
    count = lambda name: F.size(F.filter("marks", lambda x: x == name)).cast("long")
    turn = F.forall(F.transform("marks", lambda x, i: x == F.when(i % 2 == 0, "read").otherwise("write")), lambda ok: ok)
    return rows.select("id", count("read").alias("reads"), count("write").alias("writes"), turn.alias("alternate"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def first_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = sources.table(spark, d, "documents").select("doc_id", "lang")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("k <= 5").drop("k")


@query("WITH t AS (SELECT * FROM labels WHERE quality = 1 QUALIFY row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) <= 40) SELECT doc_id, toxic FROM t ORDER BY doc_id")
def index_set_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = sources.table(spark, d, "labels").filter("quality = 1").orderBy(sampling.ordered("doc_id", "5"), "doc_id").limit(40)
    return rows.select("doc_id", "toxic").orderBy("doc_id")
