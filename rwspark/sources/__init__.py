"""Sources and sinks: parallel pairs, line-aligned text, JSON documents and lines, index sets, scored cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import resolved, write_json_array  # noqa: F401
from .ordered import write as write_ordered

# Explicit schemas, as DDL: nothing is inferred.
CORPUS = "index bigint, source string, target string, src_lang string, tgt_lang string, latency string, source_chunks array<string>, target_chunks array<string>, direction string"
MATRICES = (
    "index bigint, latency string, n_src_tok int, n_tgt_tok int, gpt4_source_chunks array<string>, gpt4_target_chunks array<string>, matrix array<array<double>>, dt_sec double, entropy_matrix array<array<double>>, entropy_full array<double>"
)
META = "struct<tau_used: double, fell_back_from_primary_tau: boolean, inherited_latency: string, reassigned_latency: boolean, augmented_from_base: boolean, base_n_chunks: int, merged_to_n_chunks: int, merge_tag: string, chunks_source: string>"
TRACE = "idx int, src_words int, y_len_g int, y_len_hyp int, chunks int, al double, laal double, g_words array<int>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str | list[str], schema: str = CORPUS) -> DataFrame:
    """Documents that are one JSON array each. They can't be split: convert them to Parquet once."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines_in_turn(spark: SparkSession, paths: list[str], schema: str = MATRICES, tolerant: bool = False) -> DataFrame:
    """As json_lines, with ``file_ordinal``: the place of the argument that a record comes from, for rules by which the last one wins."""
    if not paths:
        return spark.createDataFrame([], schema + ", file_ordinal int")
    parts = [json_lines(spark, path, schema, tolerant).withColumn("file_ordinal", F.lit(k)) for k, path in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def json_lines(spark: SparkSession, path: str | list[str], schema: str = MATRICES, tolerant: bool = False) -> DataFrame:
    """One record a line, of one or more files; ``tolerant`` leaves out lines that can't be parsed."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


#: Characters that end a line for Python's splitlines, besides those that end one in a text file.
OTHER_BREAKS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Encodings of several bytes a unit, in which a line feed may be half of a character.
WIDE = ("utf-16", "utf-32")


def _raw(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines as Spark's reader splits files: at \\n, \\r and \\r\\n, in splits of any size."""
    if encoding.lower().startswith(WIDE):
        raise ValueError(f"{encoding} can't be split by lines: convert it to UTF-8")
    rows = spark.read.text(path)
    own = F.col("value") if encoding.lower() == "utf-8" else F.decode(F.col("value").cast("binary"), encoding)
    return rows.select(own.alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", breaks: str = "file") -> DataFrame:
    """pos (from 0) and line of text files; more than one are read in the order of their paths.

    The lines of each split are counted; where a split begins is a sum over those before it, a table of a row a split; within one,
    lines are numbered as they come. No file is read as a whole, and no line is moved. With ``breaks`` "all", lines end where Python's
    splitlines ends them too (a break at the very end of the last line opens an empty one).
    """
    rows = _raw(spark, path, encoding)
    if breaks == "all":
        rows = rows.select("_file", "_block", F.explode(F.split("line", OTHER_BREAKS, -1)).alias("line"))
    elif breaks != "file":
        raise ValueError("breaks: file or all")
    rows = rows.withColumn("_k", F.monotonically_increasing_id())
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = splits.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    return rows.join(starts, ["_file", "_block"]).select((F.col("_k") + F.col("_shift")).alias("pos"), "line")


def parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Line-aligned files; a difference in their numbers of lines is an error. Lines end as for Python's splitlines."""
    a, b = lines(spark, source, breaks="all"), lines(spark, target, breaks="all")
    both = a.withColumnRenamed("line", "source").join(b.withColumnRenamed("line", "target"), "pos", "full_outer")
    odd = F.raise_error(F.concat(F.lit("no partner for line "), F.col("pos").cast("string"))).cast("string")
    return both.select("pos", F.coalesce("source", odd).alias("source"), F.coalesce("target", odd).alias("target"))


def parallel_lenient(spark: SparkSession, source: str, target: str, limit: int | None = None) -> DataFrame:
    """Line-aligned files, stripped, without pairs of which a side is empty; the first ``limit`` of these."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "").alias(c)
    both = lines(spark, source).withColumnRenamed("line", "source").join(lines(spark, target).withColumnRenamed("line", "target"), "pos")
    both = both.select("pos", bare("source"), bare("target")).filter("source <> '' AND target <> ''")
    return both if limit is None else both.orderBy("pos").limit(limit)


def head_lines(spark: SparkSession, path: str, n: int, encoding: str = "utf-8") -> DataFrame:
    """The first ``n`` lines of a file, stripped, for samples: tasks are started until there are enough, the first split's first, and read no more. The lines pass through the driver."""
    found = _raw(spark, path, encoding).select(F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line")).take(n)
    return spark.createDataFrame([(k, r.line) for k, r in enumerate(found)], "pos long, line string")


def index_set(spark: SparkSession, path: str) -> DataFrame:
    """Ids of an index document, each once."""
    return spark.read.schema("indices array<bigint>").json(path, multiLine=True).select(F.explode("indices").alias("index")).distinct()


def per_sentence(spark: SparkSession, path: str) -> DataFrame:
    """A document's map of sentences as rows, the key a number again."""
    kind = "per_sentence map<string, struct<pearson: double, gpt4_chunks: int, latency: string, n_src_tok_ours: int, n_src_tok_gpt4: int, n_tgt_tok_gpt4: int, bin: string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("per_sentence").alias("key", "v"))
    return rows.select(F.col("key").cast("bigint").alias("index"), "v.*")


def results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result documents with latency and direction from their names: ..._<latency>_<direction>_n<N>.json."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    part = lambda k: F.regexp_extract(name, r"_([^_]+)_([^_]+)_n\d+\.json$", k)
    return spark.read.schema(schema).json(pattern, multiLine=True).select("*", part(1).alias("latency"), part(2).alias("direction"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A source that may be missing: then it has no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return json_lines(spark, path, schema) if there else spark.createDataFrame([], schema)


def alignments(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Word alignments, a sentence a line: ``i-j`` sure, ``ipj`` possible, counted from 1."""
    pair = F.explode(F.regexp_extract_all("line", F.lit(r"\d+[-p]\d+"), F.lit(0))).alias("a")
    part = lambda k: F.regexp_extract("a", r"(\d+)([-p])(\d+)", k)
    return lines(spark, path, encoding).select(F.col("pos").alias("sentence"), pair).select("sentence", part(1).cast("int").alias("src_pos"), part(3).cast("int").alias("tgt_pos"), F.when(part(2) == "-", "sure").otherwise("possible").alias("kind"))


def base_rows(rows: DataFrame) -> DataFrame:
    """Rows that were not made from others by merging chunks; rows without that mark count as base rows."""
    return rows.filter(~F.coalesce(F.col("_annotator_meta.augmented_from_base"), F.lit(False)))


def consistent(rows: DataFrame, source_ids: str, target_ids: str, n: str = "n", m: str = "m") -> DataFrame:
    """Rows whose texts give as many ids as the scores were made for."""
    return rows.filter((F.size(source_ids) == F.col(n)) & (F.size(target_ids) == F.col(m)))


def write_partitioned(df: DataFrame, path: str, by: str = "direction") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, key: str = "index") -> DataFrame:
    """Append the rows whose key is not there yet, so that a run that broke off can be started again; returns what is left to do before this call."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    todo = df.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti") if there else df
    todo.write.mode("append").parquet(path)
    return todo


def completion(wanted: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """One row: status DONE or NEEDS_RESUME, and how many are missing."""
    missing = wanted.select(key).distinct().join(done.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    return missing.select(F.when(F.col("missing") == 0, "DONE").otherwise("NEEDS_RESUME").alias("status"), "missing")


def write_parallel(df: DataFrame, path: str, **options: object) -> None:
    """Line-aligned ``path``.src and ``path``.ref, in the order of pos; line breaks within a text become spaces. Options as of ``ordered.write``."""
    for side, name in (("source", "src"), ("target", "ref")):
        write_ordered(df.orderBy("pos").select(F.regexp_replace(side, "\r\n|[\r\n]|" + OTHER_BREAKS, " ").alias("value")), f"{path}.{name}", **options)


# Pairs and scores from the tables.


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def _pair_id(room: int = 1 << 20) -> Column:
    turn = F.when(F.col("turn").between(0, room - 1), F.col("turn")).otherwise(F.raise_error(F.concat(F.lit("no id for turn "), F.col("turn").cast("string"))).cast("long"))
    return F.col("conv_id") * room + turn


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A user's turn and the assistant's that follows it: id, conv_id, turn, source, target. A turn beyond the ids of its conversation is an error."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("target"))
    return rows.filter("role = 'user' AND next_role = 'assistant'").select(_pair_id().alias("id"), "conv_id", "turn", F.col("text").alias("source"), "target")


def token_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with words s, t and their numbers n, m, of any length; n > 0, m > 0, as a side without words has no cells."""
    rows = pairs(spark, folder).select("id", words("source").alias("s"), words("target").alias("t"))
    return rows.select("id", "s", "t", F.size("s").alias("n"), F.size("t").alias("m")).filter((F.col("n") > 0) & (F.col("m") > 0))


def short_pairs(spark: SparkSession, folder: str, most: int = 80) -> DataFrame:
    """Of ``token_pairs`` those with n <= ``most``: the reference's filter by length, for queries whose SQL states it. Targets are whole."""
    return token_pairs(spark, folder).filter(F.col("n") <= most)


def hashed(*parts: Column | str) -> Column:
    """A number in [0, 1) from an MD5 of the parts: a stand-in for a model's score, the same in any SQL engine."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return hash_of(text)


def hash_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def joined(*parts: Column | str) -> Column:
    """The text that ``hashed`` takes, of parts that are never null."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.concat(texts[0], *(x for p in texts[1:] for x in (F.lit("|"), p)))


def divergence(i: Column, j: Column) -> Column:
    """The hash scorer of a pair (id, n) as a column: what ``cells`` has as d."""
    return (1.0 - i.cast("double") / F.col("n")) * (0.2 + 0.8 * hash_of(joined("id", i, j)))


def least_divergence(i: Column) -> Column:
    """What the hash scorer gives at the least."""
    return (1.0 - i.cast("double") / F.col("n")) * 0.2


def cells(tokens: DataFrame) -> DataFrame:
    """Divergence cells of pairs by the hash scorer: id, n, m, i (prefix, from 1), j (target word, from 0), d. The whole source has divergence 0.

    Pairs are dealt by id before they become cells, so that what is grouped by pair afterwards moves no cells.
    """
    grid = tokens.select("id", "n", "m").repartition("id").select("id", "n", "m", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    return grid.withColumn("d", divergence(F.col("i"), F.col("j")))


def from_matrices(records: DataFrame, field: str = "matrix") -> DataFrame:
    """Cells of recorded matrices."""
    rows = records.select(F.col("index").alias("id"), F.col("n_src_tok").alias("n"), F.col("n_tgt_tok").alias("m"), F.posexplode(field).alias("i", "row"))
    return rows.select("id", "n", "m", (F.col("i") + 1).alias("i"), F.posexplode("row").alias("j", "d"))
