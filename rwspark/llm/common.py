"""What the training-data operators share: the shared folder, written intermediate tables, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, \t, \n, \v, \f, \r.
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset (tests, one machine), a local one of our own. On a cluster its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rwspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: their Python may not have the driver's path.

    Batches of rows for Python are made smaller than Spark's default of 10,000, unless the session says otherwise: a row may
    hold a long text, and memory goes with the batch.
    """
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="rwspark-")) / f"{top.name}.zip"  # on the driver, which serves it
        with zipfile.ZipFile(path, "w") as out:
            for file in top.rglob("*.py"):
                out.write(file, file.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one has used."""
    return f"{shared_dir(spark)}/rwspark-{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query are deleted at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: ContextVar[tuple[list, ...]] = ContextVar("scratch", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts the lineage and survives the loss of executors. Its shuffle files go with the write, as nothing reads them again."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for tables in _SCRATCH.get():
        tables.append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[list]:
    """At its end, the tables that ``written`` made inside are deleted, but for those taken from the list."""
    tables: list = []
    token = _SCRATCH.set((*_SCRATCH.get(), tables))
    try:
        yield tables
    finally:
        _SCRATCH.reset(token)
        discard(*tables)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """``names`` of columns to carry along, each with ``kept_`` in front for as long as the result has a column of that name (in any case) or an earlier one was given it."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "kept_" + name
        used.add(name.lower())
        out.append(name)
    return out


def utf8(col: str | Column) -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")).cast("binary")


def per_batch(df: DataFrame, schema: str, make: Callable[..., list], setup: Callable[[], object] | None = None) -> DataFrame:
    """Arrow batches of ``df`` through ``make``, which gives the columns of ``schema`` in order; it also gets what ``setup`` made once for the task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [setup()] if setup else []
        for batch in batches:
            if batch.num_rows:
                columns = [x if isinstance(x, pa.Array) and x.type == t.type else pa.array(x, t.type) for x, t in zip(make(batch, *state), target, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 20_000, salts: int = 32) -> DataFrame:
    """Rows with their group's columns: a broadcast of at most ``most`` groups, else a join on salted keys, which splits large groups."""
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), keys)
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")).join(dealt, [*keys, "_salt"]).drop("_salt")


def hot_keys(rows: DataFrame, key: str, least: int = 500, most: int = 100_000) -> tuple[DataFrame, int]:
    """Keys of many rows with ``_salts``, over how many parts each is to be dealt, and the rows that make a part.

    A part has ``least`` rows, or a ``most``-th of all where that is more: so there are under ``most`` such keys at any size.
    """
    per = max(least, rows.count() // most)
    return rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > per).select(key, F.ceil(F.col("_n") / F.lit(per)).cast("int").alias("_salts")), per


def dealt_join(rows: DataFrame, table: DataFrame, key: str, own: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key. The rows of a hot key (of ``hot_keys``) are dealt over tasks by a hash of ``own``; its row in the table is sent to each."""
    hot = F.broadcast(hot)
    salted = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(own), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
