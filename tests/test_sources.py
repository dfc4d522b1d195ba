from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rwspark import sources, streaming
from rwspark.operators import latency


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_array_and_back(spark, tmp_path):
    row = {"index": 1, "source": "a b", "target": "c", "src_lang": "de", "tgt_lang": "en", "latency": "low", "source_chunks": ["a", "b"], "target_chunks": ["c", ""]}
    rows = sources.json_array(spark, put(tmp_path / "a.json", json.dumps([row, row | {"index": 2}])))
    assert [r["index"] for r in rows.orderBy("index").collect()] == [1, 2] and rows.first().direction is None
    sources.write_json_array(rows, str(tmp_path / "out"))
    assert sources.json_array(spark, str(tmp_path / "out")).count() == 2


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "m.jsonl", '{"index": 1, "n_src_tok": 2, "n_tgt_tok": 1, "matrix": [[NaN], [0.1]]}\n{"index": 2, "matr')
    rows = sources.json_lines(spark, path, tolerant=True)
    got = sources.from_matrices(rows).orderBy("i").collect()
    assert [(r.id, r.i, r.j) for r in got] == [(1, 1, 0), (1, 2, 0)] and got[0].d != got[0].d


def test_parallel_files(spark, tmp_path):
    a, b, c = put(tmp_path / "a", "x\ny\n"), put(tmp_path / "b", "1\n2\n"), put(tmp_path / "c", "1\n")
    assert [(r.source, r.target) for r in sources.parallel(spark, a, b).orderBy("pos").collect()] == [("x", "1"), ("y", "2")]
    with pytest.raises(Exception, match="no partner"):
        sources.parallel(spark, a, c).collect()
    gaps = put(tmp_path / "d", " x \n\ny\nz")
    assert [r.source for r in sources.parallel_lenient(spark, gaps, put(tmp_path / "e", "1\n2\n3\n4"), 2).orderBy("pos").collect()] == ["x", "y"]
    assert sources.head_lines(spark, gaps, 2).count() == 2


def test_documents(spark, tmp_path):
    assert {r["index"] for r in sources.index_set(spark, put(tmp_path / "i.json", json.dumps({"seed": 1, "indices": [3, 1, 3]}))).collect()} == {1, 3}
    doc = {"per_sentence": {"7": {"pearson": 0.5, "bin": "mild"}}}
    assert [(r["index"], r.pearson, r.bin) for r in sources.per_sentence(spark, put(tmp_path / "p.json", json.dumps(doc))).collect()] == [(7, 0.5, "mild")]
    put(tmp_path / "run_low_de-en_n50.json", json.dumps({"bleu": 20.5}))
    assert tuple(sources.results(spark, str(tmp_path / "*_n50.json"), "bleu double").first()) == (20.5, "low", "de-en")
    assert sources.optional(spark, str(tmp_path / "none.json"), sources.MATRICES).count() == 0


def test_alignments_are_latin_1(spark, tmp_path):
    (tmp_path / "t").write_bytes("1-1 2p3 ü\n3-2\n".encode("latin-1"))
    got = [tuple(r) for r in sources.alignments(spark, str(tmp_path / "t")).orderBy("sentence", "src_pos").collect()]
    assert got == [(0, 1, 1, "sure"), (0, 2, 3, "possible"), (1, 3, 2, "sure")]


def test_append_new_and_completion(spark, tmp_path):
    rows, path = spark.range(5).withColumnRenamed("id", "index"), str(tmp_path / "t")
    sources.append_new(rows.filter("index < 3"), path)
    assert tuple(sources.completion(rows, spark.read.parquet(path)).first()) == ("NEEDS_RESUME", 2)
    sources.append_new(rows, path)
    sources.append_new(rows, path)
    assert spark.read.parquet(path).count() == 5
    assert sources.completion(rows, spark.read.parquet(path)).first().status == "DONE"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "b", "de-en"), (1, "c", "d", "en-de")], "pos int, source string, target string, direction string")
    sources.write_partitioned(rows, str(tmp_path / "p"))
    assert (tmp_path / "p" / "direction=de-en").is_dir()
    sources.write_parallel(rows, str(tmp_path / "x"))
    assert [r.source for r in sources.parallel(spark, str(tmp_path / "x.src"), str(tmp_path / "x.ref")).orderBy("pos").collect()] == ["a", "c"]


def test_stream_is_its_batch_twin(spark):
    reads = spark.createDataFrame([(k, n, i, (k * i) % 4 == 3) for k, n in ((1, 7), (2, 3), (3, 1), (4, 9)) for i in range(1, n + 1)], "id long, n int, i int, fires boolean")
    batch = latency.drained(reads.withColumn("m", F.lit(5))).select("id", "commit", "at", "exhausted")
    assert sorted(map(tuple, streaming.replayed(reads).collect())) == sorted(map(tuple, batch.collect()))


def test_increments_are_appended_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(x,) for x in part], "index long").write.mode("append").parquet(source)
        streaming.append_increment(source, target, spark, "index long")
    assert sorted(r["index"] for r in spark.read.parquet(target).collect()) == list(range(5))
