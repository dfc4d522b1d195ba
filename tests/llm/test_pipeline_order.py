from __future__ import annotations

import corpus_pipeline as P
from rwspark.llm import mixing
from rwspark.llm.common import written


def test_token_files_are_in_mixed_order(spark, docs):
    rows = docs([(i, f"text {i}", "en", "ab"[i % 10 == 0]) for i in range(300)])
    mix = written(P.mixing_to_weights(spark, rows, ""), "test")
    assert mix.columns == rows.columns
    want = [r.doc_id for r in mixing.mixed(rows).orderBy("position").collect()]
    got = [r.doc_id for r in P.token_output(spark, mix, "").orderBy("start", "doc_id").collect()]
    assert want != sorted(want) and got == want
