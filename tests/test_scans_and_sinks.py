"""Line-aligned scans of files in many splits, and files written by many tasks, against Python's own reading."""

from __future__ import annotations

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from rwspark import sources
from rwspark.sources import ordered


@pytest.fixture(params=["23", "1000000"])
def split(spark, request):
    """Files are cut in splits of so many bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield int(request.param)
    for k, v in kept.items():
        spark.conf.set(k, v)


def ragged(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["", "a", "zwei Wörter", "漢字かな", "😀", "x" * 60, " "]) + r.choice(["\n", "\n", "\n", "\r\n", "\r", "\n\n"]) for _ in range(40))
    return text + r.choice(["", "end"])


def read(df):
    got = df.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(got)))
    return [r.line for r in got]


@pytest.mark.parametrize("seed", range(4))
def test_lines_of_split_files(spark, split, tmp_path, seed):
    path = tmp_path / "f"
    path.write_bytes(ragged(seed).encode())
    with path.open(encoding="utf-8") as f:
        want = [x.rstrip("\n") for x in f]
    assert read(sources.lines(spark, str(path))) == want
    head = sources.head_lines(spark, str(path), 7).orderBy("pos").collect()
    assert [r.line for r in head] == [x.strip() for x in want[:7]]


def test_other_breaks_and_encodings(spark, split, tmp_path):
    text = "a\x0bb c\nd\x85\ne\x1cf" * 9
    (tmp_path / "u").write_text(text, encoding="utf-8", newline="")
    assert read(sources.lines(spark, str(tmp_path / "u"), breaks="all")) == text.splitlines()
    latin = "Straße\nfür\n" * 20
    (tmp_path / "l").write_bytes(latin.encode("latin-1"))
    assert read(sources.lines(spark, str(tmp_path / "l"), "ISO-8859-1")) == latin.splitlines()
    with pytest.raises(ValueError, match="UTF-8"):
        sources.lines(spark, str(tmp_path / "l"), "UTF-16LE")
    with pytest.raises(ValueError):
        sources.lines(spark, str(tmp_path / "l"), breaks="none")


def test_several_files_and_empty_ones(spark, split, tmp_path):
    for name, text in {"p-0": "a\nb\n" * 30, "p-1": "", "p-2": "\n", "p-3": "z"}.items():
        (tmp_path / name).write_text(text)
    assert read(sources.lines(spark, f"{tmp_path}/p-*")) == ["a", "b"] * 30 + ["", "z"]
    assert sources.lines(spark, f"{tmp_path}/p-1").count() == 0 == sources.head_lines(spark, f"{tmp_path}/p-1", 3).count()


def test_aligned_files(spark, split, tmp_path):
    a, b = [f"s{k} ü" for k in range(50)], [f"t{k}" if k % 7 else " 　" for k in range(50)]
    (tmp_path / "a").write_text("\n".join(a) + "\n")
    (tmp_path / "b").write_text("\n".join(b))
    rows = sources.parallel(spark, f"{tmp_path}/a", f"{tmp_path}/b").orderBy("pos").collect()
    assert [(r.source, r.target) for r in rows] == list(zip(a, b))
    rows = sources.parallel_lenient(spark, f"{tmp_path}/a", f"{tmp_path}/b", 20).orderBy("pos").collect()
    assert [(r.source, r.target) for r in rows] == [(x, y.strip()) for x, y in zip(a, b) if y.strip()][:20]
    (tmp_path / "c").write_text("\n".join(b[:49]))
    with pytest.raises(Exception, match="no partner for line 49"):
        sources.parallel(spark, f"{tmp_path}/a", f"{tmp_path}/c").collect()


def test_one_file_of_many_tasks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("line "), "id").alias("value")).repartition(7)
    ordered.write(rows.orderBy("id").select("value"), f"{tmp_path}/deep/er/out.txt")
    assert (tmp_path / "deep/er/out.txt").read_text() == "".join(f"line {k}\n" for k in range(1000))
    assert os.listdir(tmp_path / "deep/er") == ["out.txt"]
    ordered.write(rows.filter("id < 2").orderBy(F.desc("id")).select(F.when(F.col("id") == 1, F.col("value")).alias("value")), f"{tmp_path}/deep/er/out.txt")
    assert (tmp_path / "deep/er/out.txt").read_text() == "line 1\n\n"
    ordered.write(rows.limit(0).select("value"), f"{tmp_path}/none")
    assert (tmp_path / "none").read_text() == ""


def test_json_document_of_many_tasks(spark, tmp_path):
    rows = spark.range(300).select("id", F.array(F.lit("ü"), F.col("id").cast("string")).alias("c")).repartition(5).orderBy(F.desc("id"))
    sources.write_json_array(rows, f"{tmp_path}/a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": k, "c": ["ü", str(k)]} for k in reversed(range(300))]
    sources.write_json_array(rows.limit(0), f"{tmp_path}/b.json")
    assert json.loads((tmp_path / "b.json").read_text()) == []


def test_parallel_files_of_many_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("pos"), F.concat(F.lit("s\r\n"), "id").alias("source"), F.concat(F.lit("t "), "id").alias("target")).repartition(6)
    sources.write_parallel(rows, f"{tmp_path}/x")
    got = sources.parallel(spark, f"{tmp_path}/x.src", f"{tmp_path}/x.ref").orderBy("pos").collect()
    assert [(r.source, r.target) for r in got] == [(f"s {k}", f"t {k}") for k in range(200)]


def test_failed_tasks_leave_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("odd row"))).otherwise("x").cast("string").alias("value"))
    (tmp_path / "out").write_text("as it was")
    with pytest.raises(Exception, match="odd row"):
        ordered.write(bad, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == ["out"] and (tmp_path / "out").read_text() == "as it was"
    with pytest.raises(Exception, match="one column"):
        ordered.write(spark.range(3), f"{tmp_path}/out")


def test_waits_double():
    waits, left = [], [4]

    def action():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError(5, "transient")
        return "done"

    assert ordered.patient(action, 5, 1.0, waits.append) == "done" and waits == [1, 2, 4, 8]
    with pytest.raises(OSError):
        ordered.patient(lambda: (_ for _ in ()).throw(OSError("never")), 3, 1.0, waits.append)
    assert waits[4:] == [1, 2]


def test_sink_that_fails_for_a_while(spark, tmp_path):
    """The folder is a file until the sink has failed a few times."""
    rows, place = spark.range(5).select(F.col("id").cast("string").alias("value")).coalesce(1), tmp_path / "later"
    place.write_text("in the way")

    def clear():
        time.sleep(4)
        place.unlink()

    thread = threading.Thread(target=clear)
    thread.start()
    ordered.write(rows, f"{place}/out", scratch=str(tmp_path), tries=8, wait=0.2)
    thread.join()
    assert (place / "out").read_text() == "0\n1\n2\n3\n4\n" and sorted(os.listdir(tmp_path)) == ["later"]


def test_fallback_that_readers_resolve(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").cast("string").alias("value")).coalesce(1)
    (tmp_path / "blocked").write_text("a file, for good")
    path, other = f"{tmp_path}/blocked/out", f"{tmp_path}/other"
    with pytest.raises(FileNotFoundError):
        ordered.resolved(path, other)
    ordered.write(rows, path, fallback=other, scratch=str(tmp_path), tries=2, wait=0.1)
    assert ordered.resolved(path, other) == f"{other}/out" and read(sources.lines(spark, ordered.resolved(path, other))) == ["0", "1", "2"]
    with pytest.raises(Exception):
        ordered.write(rows, path, scratch=str(tmp_path), tries=2, wait=0.1)
    ordered.write(rows, f"{tmp_path}/out", fallback=other)
    assert ordered.resolved(f"{tmp_path}/out", other) == f"{tmp_path}/out" and sorted(os.listdir(tmp_path)) == ["blocked", "other", "out"]


def test_records_know_their_argument(spark, tmp_path):
    for name, value in (("b", 1), ("a", 2), ("c", 3)):
        (tmp_path / name).write_text(json.dumps({"index": 7, "v": value}) + "\n")
    paths = [f"{tmp_path}/{x}" for x in "bca"]
    rows = sources.json_lines_in_turn(spark, paths, "index long, v int")
    assert rows.groupBy("index").agg(F.max_by("v", "file_ordinal").alias("v")).first().v == 2 and rows.count() == 3
    assert sources.json_lines_in_turn(spark, [], "index long, v int").count() == 0
