from __future__ import annotations

import pytest

from rwspark.llm import queries, sql
from tests.oracle import of_frame, of_sql


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_matches_sql(spark, small, name):
    assert of_frame(queries.QUERIES[name](spark, small)) == of_sql(sql.ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.ORACLE)))
def test_query_gives_all_rows(spark, small, name):
    tables = {"op2_html_extraction": ["pages"], "op9_language_id": ["pages", "documents"]}.get(name, ["documents"])
    rows = queries.QUERIES[name](spark, small)
    if name == "op13_packing":  # a row for each piece
        rows = rows.filter("start = 0")
    assert rows.count() == sum(spark.read.parquet(f"{small}/{t}.parquet").count() for t in tables)


def test_pipeline(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small)
        path = P.written(out, "test")
        if k < len(P.STAGES) - 1:
            assert path.columns == columns, name
        kept = {r.doc_id for r in path.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and kept, name
        if name.startswith("mixing"):
            assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
        docs = path
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
