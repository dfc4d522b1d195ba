"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, importance, jaccard, langid, mixing, packing, periodic, quality, secret_scan, token_counts, token_records, warc
from .common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"] != "novel")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), count("novel").alias("n_novel"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents")).select("doc_id", *quality.NAMES, "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(decontam.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.round_trip(table(spark, sf_dir, "documents"), tokenizer_path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and all documents by their text and source."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fitted(docs)
    pages = langid.identified(langid.page_evidence(table(spark, sf_dir, "pages"), model), model[0])
    found = pages.unionByName(langid.identified(langid.document_evidence(docs, model), model[0]), allowMissingColumns=True)
    return found.select("page_id", "doc_id", "url", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), pieces_path)


def looped(docs: DataFrame) -> DataFrame:
    """The contract's rows: in one document of ten, by a hash of its id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    word = lambda i: F.get("w", F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, split).alias("w"))
    return rows.select("doc_id", F.when(F.size("w") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), word), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detected(looped(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("before"), (-x["period"]).alias("least"))))
    length, period = F.col("best.length"), -F.col("best.least")
    columns = [F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli")]
    return found.withColumn("best", best).select("doc_id", *columns, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(packing.sequences(table(spark, sf_dir, "documents"), tokenizer_path))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step")


def shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: shipped(f) for f in (op1_secret_scan, op2_html_extraction, op3_quality_rules, op4_mixing, op5_ngram_jaccard, op6_warc, op7_decontamination, op8_token_records, op9_language_id, op10_token_counts, op11_periodic_runs, op12_importance_resampling, op13_packing)}
