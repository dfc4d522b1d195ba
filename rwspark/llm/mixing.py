"""Mixing sources to target weights by Pfair scheduling.

DataFrame functions only. The mix lasts until every source has given each of its documents once; sources that are due more
than they have start again (a later epoch). It is cut into slots, each of one block of documents: about ``slots`` of them,
or one for each document where these are fewer. With weight w, block k of a source (from 0) is released at slot floor(k / w)
and due by slot ceil((k + 1) / w); earliest deadline first gives each slot to a released block, so after any slot each
source has had its weight's share to within one block. Weights are whole numbers (a share times 10^12), windows are computed
from them without rounding, and all blocks are full: a source's documents are an endless stream that blocks are cut from.

The plan, not the data, is made in one task: a fold over its slots. It ends with the slot in which the last source ends its
first pass; as blocks are whole, that may be one block of that source later than documents alone would need. A document finds
its block by division. The blocks of ``frame`` slots that follow each other are read in turn, a document of each: so a run of
so many documents is mixed however large blocks are. Within a frame, what a source is off is a mean of what it is off at the
frame's ends and in its first turn: still less than one block.

Sources whose share is less than one block in all are one stream of the plan, in the order of a hash: they can't be off by a
block. So there is no limit to the number of sources. Ranks in a stream are row numbers within parts of it (by hash) plus the
counts of the parts before, so a hot source is dealt over many tasks.

A null source counts as the empty name. Null and repeated ids are placed like others; rows that tie are interchangeable.
Texts of any kind and length are carried along unread. An empty table gives no rows. Sources that ``weights`` lacks, and
negative weights, are errors; a weight of 0 leaves the source out. Columns named ``slot``, ``position`` and ``epoch`` are
replaced by those of the mix; all others, of any name, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, written

UNIT = 10**12
#: The stream of the small sources: a name that no source's key has.
SMALL = "small"
#: More than there can be streams, which are one more than slots at most.
PLACES = 1 << 16


def _name(column: str = "source"):
    return F.coalesce(column, F.lit(""))


def shares(docs: DataFrame, weights: DataFrame | None, alpha: float, slots: int) -> DataFrame:
    """_mix_source, docs, q (weight, a whole number), total (of all q), due (documents in the mix), slots, block and big (it has a block or more), of sources of a weight over 0.

    Weights are from ``weights`` (source, weight), else a power of the source's size.
    """
    sizes = docs.groupBy(_name().alias("_mix_source")).agg(F.count("*").alias("docs"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("docs").cast("double"), F.lit(alpha)))
    else:
        known = weights.select(_name().alias("_mix_source"), F.col("weight").cast("double").alias("weight"))
        wrong = lambda text: F.raise_error(F.concat(F.lit(text), "_mix_source")).cast("double")
        sizes = sizes.join(known, "_mix_source", "left").withColumn("weight", F.when(F.col("weight").isNull(), wrong("no weight for source ")).when(F.col("weight") < 0, wrong("negative weight for source ")).otherwise(F.col("weight")))
    sizes = sizes.filter("weight > 0")
    all = F.broadcast(sizes.agg(F.sum("weight").alias("weights")))  # single rows, these
    sizes = sizes.crossJoin(all).withColumn("q", F.greatest(F.lit(1), F.round(F.col("weight") / F.col("weights") * UNIT).cast("long")))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("q").alias("total"))))
    one = sizes.agg(F.max(F.col("docs") * (F.col("total") / F.col("q"))).alias("length")).withColumn("slots", F.least(F.lit(slots).cast("long"), F.ceil("length")))
    one = one.withColumn("block", F.ceil(F.col("length") / F.col("slots")))
    sizes = sizes.crossJoin(F.broadcast(one))
    due = F.greatest(F.col("docs"), F.floor(F.col("length") * (F.col("q") / F.col("total"))).cast("long"))
    return sizes.select("_mix_source", "docs", "q", "total", due.alias("due"), "slots", "block", (F.col("q") * F.col("slots") >= F.col("total")).alias("big"))


def streams(sources: DataFrame) -> DataFrame:
    """stream, q, total, need (blocks until each document is given once), docs and slots: a row for each big source, and one for all others. A bounded table: a big source has a slot at least."""
    key = F.when(F.col("big"), F.concat(F.lit("="), F.col("_mix_source"))).otherwise(F.lit(SMALL))
    own = F.when(F.col("big"), F.col("docs")).otherwise(F.col("due"))
    rows = sources.groupBy(key.alias("stream")).agg(F.sum("q").alias("q"), F.first("total").alias("total"), F.sum(own).alias("docs"), F.first("block").alias("block"), F.first("slots").alias("slots"))
    return rows.select("stream", "q", "total", F.ceil(F.col("docs") / F.col("block")).alias("need"), "docs", "slots")


def schedule(rows: DataFrame) -> DataFrame:
    """stream, turn (the block's number) and slot: earliest deadline first, ties to the first stream by name; ``rows`` as of ``streams``. What the small sources need is due by the last slot at the latest."""
    one = rows.agg(F.array_sort(F.collect_list(F.struct("stream", "q", "need"))).alias("s"), F.first("total").alias("total"), F.first("slots").alias("slots"))
    one = one.withColumn("q", F.col("s.q")).withColumn("clip", F.transform("s", lambda x: F.when(x["stream"] == SMALL, x["need"]).otherwise(0)))
    div = lambda x, y: F.call_function("div", x, y)

    def due(n, q, i):
        by = div((n + 1) * F.col("total") + q - 1, q)
        return F.when(n < F.get("clip", i), F.least(F.col("slots"), by)).otherwise(by)

    one = written(one.withColumn("length", F.array_max(F.transform("s", lambda x, i: due(x["need"] - 1, x["q"], i)))), "streams")  # so that no slot computes them again

    def window(n, q, i):
        """The stream's next block, the slot of its release, and its deadline with the stream's place behind it."""
        return F.struct(n.alias("n"), div(n * F.col("total"), q).alias("release"), (due(n, q, i) * PLACES + i).alias("key"))

    def step(state, t):
        def dealt(pick):
            return F.struct(F.transform(state["next"], lambda x, i: F.when(i == pick, window(x["n"] + 1, F.get("q", i), i)).otherwise(x)).alias("next"), F.concat(state["picks"], F.array(pick)).alias("picks"))

        pick = F.array_min(F.transform(state["next"], lambda x: F.when(x["release"] > t, x["key"] + (1 << 62)).otherwise(x["key"]))) % PLACES
        return F.get(F.transform(F.array(pick), dealt), F.lit(0))  # the pick is found once a slot, not once for each stream

    empty = F.struct(F.transform("q", lambda q, i: window(F.lit(0).cast("long"), q, i)).alias("next"), F.array().cast("array<bigint>").alias("picks"))
    picks = F.transform(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), empty, step)["picks"], lambda i: i.cast("int"))
    flat = one.filter("length > 0").select("s", picks.alias("picks")).select("s", F.posexplode("picks").alias("slot", "i"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    flat = flat.select(F.get("s", F.col("i"))["stream"].alias("stream"), turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"), (F.get("s", F.col("i"))["need"] - 1 == turn).alias("last"))
    end = flat.filter("last").agg(F.max("slot").alias("end"))  # one row
    return flat.crossJoin(F.broadcast(end)).filter("slot <= end").select("stream", "turn", "slot")


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``_mix_rank`` among those of the same ``by``, from 0, in the order of ``_mix_key`` (a hash)."""
    rows = rows.withColumn("_mix_part", F.substring("_mix_key", 1, 3))
    parts = rows.groupBy(by, "_mix_part").agg(F.count("*").alias("_mix_n"))
    before = F.sum("_mix_n").over(Window.partitionBy(by).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_mix_n")  # 4096 parts at most
    parts = parts.select(by, "_mix_part", before.alias("_mix_before"))
    within = F.row_number().over(Window.partitionBy(by, "_mix_part").orderBy("_mix_key", "doc_id"))
    return rows.withColumn("_mix_within", within).join(parts.hint("merge"), [by, "_mix_part"]).withColumn("_mix_rank", F.col("_mix_before") + F.col("_mix_within") - 1).drop("_mix_part", "_mix_before", "_mix_within")


def mixed(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.7, slots: int = 4096, frame: int = 256, seed: str = "mix") -> DataFrame:
    """``docs`` with ``slot`` (of the block), ``position`` (its place in the mix) and ``epoch``, once for every time a document is given."""
    if not 1 <= slots < PLACES:
        raise ValueError(f"slots: 1 to {PLACES - 1}")
    docs = docs.drop("slot", "position", "epoch")
    columns = docs.columns
    sources = written(shares(docs, weights, alpha, slots), "sources")
    plan = written(schedule(streams(sources)), "schedule")
    turns = plan.groupBy("stream").agg(F.count("*").alias("turns"))
    known = streams(sources).select("stream", F.col("docs").alias("all")).join(turns, "stream")
    known = sources.withColumn("stream", F.when(F.col("big"), F.concat(F.lit("="), F.col("_mix_source"))).otherwise(F.lit(SMALL))).join(F.broadcast(known), "stream")  # a row for each stream
    known = known.select(*("_mix_source", F.col("stream").alias("_mix_stream")), *(F.col(c).alias(f"_mix_{c}") for c in ("docs", "due", "block", "big", "all")), (F.col("turns") * F.col("block")).alias("_mix_given"))

    # Rows without an id are told apart by all their columns.
    own = F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(*(F.col(c) for c in columns if c != "doc_id")).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("_mix_row"), "doc_id", _name().alias("_mix_source"), F.md5(F.concat(F.lit(seed + ":"), own).cast("binary")).alias("_mix_key"))
    rows = attach(ranked(rows, "_mix_source"), written(known, "sources"), ["_mix_source"])
    given, size, rank = F.col("_mix_given"), F.col("_mix_docs"), F.col("_mix_rank")
    again = lambda place, every, upto: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((upto - 1 - place) / every)))
    dealt = rows.filter("_mix_big AND _mix_rank < _mix_given").withColumn("epoch", again(rank, size, given)).withColumn("_mix_place", rank + F.col("epoch") * size)
    if not sources.filter("NOT big").isEmpty():
        small = rows.filter("NOT _mix_big").withColumn("epoch", again(rank, size, F.col("_mix_due"))).withColumn("_mix_key", F.md5(F.concat_ws(":", "_mix_key", "epoch").cast("binary")))
        small = small.withColumn("_mix_times", F.floor((F.col("_mix_due") - 1 - rank) / size) + 1).drop("_mix_rank")
        small = ranked(small, "_mix_stream").withColumn("_mix_cycle", again(F.col("_mix_rank"), F.col("_mix_all"), given))
        small = small.withColumn("epoch", F.col("epoch") + F.col("_mix_cycle") * F.col("_mix_times")).withColumn("_mix_place", F.col("_mix_rank") + F.col("_mix_cycle") * F.col("_mix_all"))
        dealt = dealt.unionByName(small.drop("_mix_times", "_mix_cycle"))
    block, at = F.col("_mix_block"), F.col("_mix_place")
    dealt = dealt.withColumn("_mix_turn", F.floor(at / block))
    plan = plan.crossJoin(F.broadcast(plan.agg(F.count("*").alias("_mix_length"))))  # one row
    plan = plan.select(F.col("stream").alias("_mix_stream"), F.col("turn").alias("_mix_turn"), "slot", "_mix_length")
    dealt = dealt.join(F.broadcast(plan), ["_mix_stream", "_mix_turn"])  # a row for each slot
    start = F.floor(F.col("slot") / F.lit(frame)) * frame
    width = F.least(F.lit(frame), F.col("_mix_length") - start)
    position = start * block + F.pmod(at, block) * width + F.col("slot") - start
    return dealt.select("_mix_row.*", "slot", position.cast("long").alias("position"), "epoch")
