"""A training corpus from ``documents``: quality rules, near copies, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``, and other columns are left out. Near copies share 80 % of their five-word shingles or more, and the least id
of a group stays. Mixing drops nothing: a document of a source whose weight exceeds its size is given once in each epoch. Its
order is that of the rows in its Parquet files, and the token files keep it.

Texts that are null, empty or short are rejected by the quality rules; a null language or source is a group of its own; rows
without an id are kept, but are never copies of others; rows that share an id are one document, and one of them stays. Texts
are read as a whole at any length. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rwspark.llm import decontam, jaccard, mixing, quality, token_records
from rwspark.llm.common import scratch, ship, written
from rwspark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    stats = written(quality.statistics(docs, COLUMNS), "statistics")
    return quality.judged(stats).filter("kept").select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 1_000_000) -> DataFrame:
    """One document of each group of near copies: that with the least id."""
    ship(spark)
    with scratch() as made:
        found = written(jaccard.classes(docs, size=5, percent=80), "classes")
        made.remove(found)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(F.broadcast(gone) if gone.count() <= most else gone, "doc_id", "left_anti")
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    return kept.select(*COLUMNS) if twice.isEmpty() else kept.select(*COLUMNS).filter("doc_id IS NULL").unionByName(kept.select(*COLUMNS).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of a twentieth of their words or more."""
    ship(spark)
    found = decontam.occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS[1:])
    return decontam.judged(found).filter("NOT contaminated").select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in its order within and between files, which ``position`` holds."""
    return mixing.mixed(docs.select(*COLUMNS)).repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the token files, which are in the order of the mix: that of ``docs``' Parquet files and of the rows in them."""
    ship(spark)
    return token_records.round_trip(docs, tokenizer_path, stored=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_weights),
    ("token records", token_output),
]

#: Iterative estimates and a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs, "stage"), sf_dir)
    return docs
