"""Queries of replayed writes, offline output, joined prefixes, cached prompts and the bin report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rwspark import functions as R
from rwspark import sources
from rwspark.operators import cache, commit, latency, replay
from rwspark.streaming import writes

from . import oracle as o
from .committing import _GATE, _bins, _nearest
from .corpus import _INSTRUCTION, _TGT, _WITH_LATENCY, _rows
from .measures import _WAIT, _drain

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


# What is written at the commits of wait-3: a hashed stand-in of a model's ids, of which three in fifty end a write.
_WRITES = _WAIT + f""", ws AS (SELECT id, k, commit, r, floor({o.hashed("'write|' || id || '|' || k || '|' || r")} * 50)::INT AS v FROM steps, range(48) x(r)),
wrote AS (SELECT id, k::INT AS at, commit::INT AS commit, coalesce(min(r) FILTER (v < 3 AND r < 40), 40)::INT AS n_ids,
  CASE arg_min(v, r) FILTER (v < 3 AND r < 40) WHEN 0 THEN 'eow' WHEN 1 THEN 'eos' WHEN 2 THEN 'eor' END AS ended, count(*) FILTER (v < 3 AND r < 40) = 0 AS cap_hit FROM ws GROUP BY id, k, commit)"""


def stream(length: int = 48) -> Column:
    def one(r):
        v = F.floor(sources.hashed(F.lit("write"), "id", "at", r) * 50).cast("int")
        return F.when(v == 0, R.SPECIAL_IDS["eow"]).when(v == 1, 1).when(v == 2, R.SPECIAL_IDS["eor"]).otherwise(v + 10)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), one)


def _reads(spark: SparkSession, d: str) -> DataFrame:
    tokens = sources.short_pairs(spark, d)
    return tokens.select("id", "n", "m", F.posexplode("s").alias("p", "w")).withColumn("i", F.col("p") + 1).withColumn("fires", latency.policy("wait_k", k=3))


@query(_WRITES + " SELECT * FROM wrote")
def write_termination(spark: SparkSession, d: str) -> DataFrame:
    rows = replay.replayed(_reads(spark, d), stream())
    return rows.select("id", "at", "commit", F.size("ids").alias("n_ids"), "ended", "cap_hit")


# Recorded writes: from the place in the target that is as far on as the read, word by word; a full stop ends the sentence, a comma the write.
_RECORDED = _WAIT + """, ws AS (SELECT steps.id, k, commit, t[((commit - 1) * steps.m // steps.n) + 1 : ((commit - 1) * steps.m // steps.n) + 40] AS ws FROM steps JOIN tokens ON steps.id = tokens.id),
ends AS (SELECT *, coalesce(list_position(list_transform(ws, lambda w: regexp_matches(w, '[.,]$')), true), 0) AS p FROM ws)
SELECT id, k::INT AS at, commit::INT AS commit, CASE WHEN p > 0 THEN p - 1 ELSE len(ws) END::INT AS n_ids, CASE WHEN p > 0 THEN CASE WHEN ws[p] LIKE '%.' THEN 'eos' ELSE 'eow' END END AS ended, p = 0 AND len(ws) >= 40 AS cap_hit, false AS timed_out FROM ends"""


def recorded(target: Column, i: Column, n: Column, m: Column, length: int = 48) -> Column:
    """Ids that a write after source word ``i`` of ``n`` would give."""
    start = F.floor((i - 1) * m / n).cast("int")
    return F.transform(F.slice(target, start + 1, length), lambda w: F.when(w.endswith("."), 1).when(w.endswith(","), R.SPECIAL_IDS["eow"]).otherwise(R.word_id(w)))


@query(_RECORDED)
def stream_writes(spark: SparkSession, d: str) -> DataFrame:
    """Reads and writes of wait-3 as a stream with keyed state, over recorded ids."""
    reads = sources.short_pairs(spark, d).select("id", "n", "m", "t", F.posexplode("s").alias("p", "w")).withColumn("i", F.col("p") + 1)
    reads = reads.select("id", "n", "i", latency.policy("wait_k", k=3).alias("fires"), recorded(F.col("t"), F.col("i"), F.col("n"), F.col("m")).alias("ids"), writes.arrival().alias("ts"))
    return writes.replayed(reads).select("id", "at", "commit", F.size("ids").alias("n_ids"), "ended", "cap_hit", "timed_out")


@query(_WRITES + " SELECT id, count(*) AS chunks, sum(n_ids)::BIGINT AS n_ids, count(*) FILTER (cap_hit) AS write_cap_hits FROM wrote GROUP BY id")
def write_cap_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = replay.replayed(_reads(spark, d), stream())
    return rows.groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.size("ids")).alias("n_ids"), F.count_if("cap_hit").alias("write_cap_hits"))


@query(_drain(f"(i % 3 = 0 AND {o.hashed(chr(39) + 'span|' + chr(39) + ' || id || ' + chr(39) + '|' + chr(39) + ' || i')} >= 0.1e0)"))
def policy_empty_spans(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the words have no ids."""
    span = F.when(sources.hashed(F.lit("span"), "id", "i") >= 0.1, F.array(R.word_id(F.col("w")))).otherwise(F.array().cast("array<int>"))
    reads = _reads(spark, d).withColumn("fires", replay.checked(F.col("fires"), span))
    return latency.drained(reads).select("id", "commit", "at", "exhausted")


@query(o.TOKENS + " SELECT id, '<|medium-latency|> ' || array_to_string(s, ' ') || ' <|end-of-read|>' AS prompt, 1 AS chunks, list_sum(list_transform(range(0, m), lambda i: n))::BIGINT AS sum_lag, n::DOUBLE AS al, round(n - (m - 1) / 2e0 * n / m, 6) AS laal FROM tokens")
def offline(spark: SparkSession, d: str) -> DataFrame:
    tokens = sources.short_pairs(spark, d).withColumn("prompt", replay.offline_prompt(F.lit("medium"), F.array_join("s", " ")))
    rows, n, m = replay.offline(tokens, "prompt"), F.col("n"), F.col("m")
    total = F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("id", "prompt", "chunks", total.alias("sum_lag"), latency.average_lagging(F.col("g"), n, m).alias("al"), F.round(latency.length_adaptive(F.col("g"), n, m), 6).alias("laal"))


def _lengths(side: str) -> str:
    return f"list_transform(range(1, len({side}) + 1), lambda k: len(regexp_extract_all(array_to_string({side}[1:k], ' '), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))::INT)"


@query(
    _WITH_LATENCY
    + f""", lens AS (SELECT id, {_lengths('src')} AS a, {_lengths('tgt')} AS b FROM rows)
SELECT id, array_to_string(a, ' ') AS source_lengths, array_to_string(b, ' ') AS target_lengths, list_sum(list_transform(b, lambda x, k: a[k] * (x - CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END)))::BIGINT AS sum_commit FROM lens"""
)
def joined_prefix_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("id", R.joined_lengths(F.col("source_chunks")).alias("a"), R.joined_lengths(F.col("target_chunks")).alias("b"))
    trace = R.commits_of_lengths(F.col("a"), F.col("b"))
    return rows.select("id", F.array_join("a", " ").alias("source_lengths"), F.array_join("b", " ").alias("target_lengths"), F.aggregate(trace, F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_commit"))


_OPEN = f"'<start_of_turn>user' || chr(10) || {_INSTRUCTION} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)"
_PIECE_IDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 50000 + 10)::INT)"


@query(_WITH_LATENCY + f" SELECT id, array_to_string({_PIECE_IDS.format(_OPEN)}, ' ') AS prefix_ids, array_to_string({_PIECE_IDS.format(chr(39) + '<end_of_turn>' + chr(39))}, ' ') AS suffix_ids FROM rows")
def prefix_cache(spark: SparkSession, d: str) -> DataFrame:
    """Ids before and after the assistant's text, made once for each language pair and latency."""
    ids = lambda text: F.array_join(F.transform(R.pieces(text), R.word_id), " ")
    whole = R.chat(R.user_instruction(F.col("latency"), F.col("src_lang"), F.col("tgt_lang")), F.lit("\0"))
    part = lambda k: ids(F.get(F.split(whole, "\0"), F.lit(k)))
    rows = _rows(spark, d).select("id", "latency", F.lit("de").alias("src_lang"), F.expr(_TGT).alias("tgt_lang"))
    return cache.cached(rows, ["src_lang", "tgt_lang", "latency"], prefix_ids=part(0), suffix_ids=part(1)).select("id", "prefix_ids", "suffix_ids")


_NAMES = ("ref_chunks", "chunks", "delta", "ref_pearson", "pearson", "tau")
_REPORT = _GATE.rsplit(", rbins AS", 1)[0] + """, wide AS (SELECT CASE WHEN r.pearson >= 0.9 THEN 'monotone' WHEN r.pearson < 0.7 THEN 'reordering' ELSE 'mild' END AS bin,
  want::DOUBLE AS ref_chunks, matched.chunks::DOUBLE AS chunks, delta::DOUBLE AS delta, r.pearson AS ref_pearson, matched.pearson AS pearson, tau
  FROM matched JOIN rsums r USING (id) WHERE r.pearson IS NOT NULL AND NOT isnan(r.pearson)), """
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT bin, '{name}' AS name, {name} AS v FROM wide" for name in _NAMES) + ")"


@query(_REPORT + _LONG + " SELECT bin, name, count(v) AS n, round(avg(v), 6) AS mean, round(list_sort(list(v) FILTER (v IS NOT NULL))[1 + count(v) // 2], 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max FROM long GROUP BY bin, name")
def bin_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Six figures of each bin: chunks of the reference and of the matched trace, their difference, both Pearson coefficients, and the threshold."""
    tokens = sources.short_pairs(spark, d)
    best = _nearest(tokens)
    bins = _bins(tokens).select("id", F.col("pearson").alias("ref_pearson"), "bin").filter("bin <> 'undefined'")
    values = {"ref_chunks": F.col("want"), "chunks": F.col("chunks"), "delta": F.col("delta"), "ref_pearson": F.col("ref_pearson"), "pearson": F.col("pearson"), "tau": F.col("tau")}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), values[name].cast("double").alias("v")) for name in _NAMES))).alias("x")
    return commit.summarised(best.join(bins, "id").select("bin", each).select("bin", "x.*"), ["bin", "name"], "v")


@query(
    o.TOKENS + ", every AS (SELECT pairs.id AS id, tokens.n AS n, ceil(tokens.n / 4) AS c FROM pairs LEFT JOIN tokens USING (id)) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN c < 2 OR m < 2 THEN 'undefined' ELSE 'used' END AS reason, count(*) AS n FROM every LEFT JOIN (SELECT id, m FROM tokens) USING (id) GROUP BY 1"
)
def skip_counters(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by what becomes of them in the bin report: missing (too long for a reference), undefined, or used."""
    bins = _bins(sources.short_pairs(spark, d)).select("id", "bin")
    return commit.skipped(sources.pairs(spark, d), bins).groupBy("reason").agg(F.count("*").alias("n"))
