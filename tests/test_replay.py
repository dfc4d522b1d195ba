from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rwspark import functions as R
from rwspark.operators import annotate, cache, commit, replay


def test_a_write_ends_at_the_first_mark_or_the_cap(spark):
    eor, eow = R.SPECIAL_IDS["eor"], R.SPECIAL_IDS["eow"]
    cases = {
        "eow": ([7, 8, eow, 9, eor], [7, 8], "eow", False),
        "eos": ([1, 7], [], "eos", False),
        "eor": ([7, eor, eow], [7], "eor", False),
        "at the cap": ([5] * 40 + [eow], [5] * 40, None, True),
        "before the cap": ([5] * 39 + [eow], [5] * 39, "eow", False),
        "broken off": ([5, 6], [5, 6], None, False),
        "empty": ([], [], None, False),
    }
    rows = spark.createDataFrame([(name, ids) for name, (ids, *_) in cases.items()], "name string, ids array<int>")
    for row in rows.select("name", replay.written_chunk(F.col("ids")).alias("w")).collect():
        assert (list(row.w.ids), row.w.ended, row.w.cap_hit) == cases[row.name][1:], row.name


def test_words_without_ids_are_read_but_not_checked(spark):
    rows = spark.createDataFrame([(1, True, [3]), (2, True, []), (3, True, None), (4, False, [3])], "i int, fires boolean, span array<int>")
    assert [r.x for r in rows.orderBy("i").select(replay.checked(F.col("fires"), F.col("span")).alias("x")).collect()] == [True, False, False, False]


def test_joined_lengths_are_of_joined_prefixes(spark):
    row = spark.range(1).select(
        R.joined_lengths(F.array(F.lit("a b,"), F.lit(""), F.lit("c"))).alias("a"),
        R.joined_lengths(F.array().cast("array<string>")).alias("none"),
        R.commits_of_lengths(F.array(F.lit(2), F.lit(5)), F.array(F.lit(1), F.lit(3))).alias("g"),
    ).first()
    assert (row.a, row.none, row.g) == ([3, 3, 4], [], [2, 5, 5])


@pytest.mark.parametrize("most", [10_000, 0])
def test_cached_columns_meet_all_rows(spark, most):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id int, k string")
    got = cache.cached(rows, ["k"], most, made=F.concat(F.coalesce("k", F.lit("?")), F.lit("!")))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, "a", "a!"), (2, None, "?!"), (3, "a", "a!"), (4, None, "?!")]


def test_summaries_leave_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", math.nan), ("x", None), ("x", 4.0), ("x", 9.0), ("y", None)], "g string, v double")
    got = {r.g: (r.n, r["mean"], r["median"], r["min"], r["max"]) for r in commit.summarised(rows, ["g"], "v").collect()}
    assert got == {"x": (4, 4.25, 4.0, 1.0, 9.0), "y": (0, None, None, None, None)}


def test_annotation_options(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "c"], ["x", "y"], 4, 2, "de", "en")], "id long, s array<string>, t array<string>, n int, m int, src_lang string, tgt_lang string")
    for criterion in ("js", "kl", "ot"):
        row = annotate.annotate(rows, "prefix", 0.01, criterion=criterion, full_matrix=True, record_entropy=True, prompt_mode="chat").first()
        assert len(row.matrix) == 4 and all(len(x) == 2 for x in row.matrix) and len(row.entropy) == 4
        # the entropy term leaves a transport of some mass even between equal distributions
        assert row.matrix[3][0] < 0.05 < row.matrix[0][0], criterion
        assert row.prompt.startswith("Translate the following German text to English.")
    strided = annotate.annotate(rows, "prefix", 0.01, stride=2, full_matrix=True, record_entropy=True).first()
    assert len(strided.matrix) == len(strided.entropy) == 3  # prefixes 1, 3 and the whole
    with pytest.raises(ValueError):
        annotate.annotate(rows, "prefix", criterion="none")
