from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table: texts, or rows with (doc_id, text, lang, source)."""

    def make(rows, extra: bool = False):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s") for i, r in enumerate(rows)]
        frame = spark.createDataFrame([(a, t, lang, s, len(t or "")) for a, t, lang, s in rows], DOC)
        if extra:  # names that operators use inside
            from pyspark.sql import functions as F

            for name in ("id", "n", "g", "rank", "sig", "_text", "payload", "spans", "component", "turn", "_source", "x0", "d2", "findings"):
                frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make


@pytest.fixture(scope="session")
def edge_texts():
    return [None, "", " \n\t ", "one", "a b c", "word " * 40_000, "ünïcode ſtraße K 漢字  x", "same text here", "same text here", "x" * 100_000, "line\nline\n\nline"]
