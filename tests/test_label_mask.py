from __future__ import annotations

from rwspark.plans import corpus


def test_labels_are_cut_at_1024(spark):
    rows = spark.createDataFrame([(n, list(range(1, n + 1))) for n in (3, 97, 1023, 1024, 1025, 3000)], "id long, ids array<int>")
    for r in corpus.masked(rows).collect():
        want = [-100, -100, *range(3, min(r.id, 1024) + 1)]
        assert (r.labels, r.attended) == (" ".join(map(str, want)), len(want))


def test_query_keeps_late_labels(spark, small):
    got = {r.id: r.attended for r in corpus.QUERIES["label_mask"](spark, small).collect()}
    n = {r.id: len(r.ids.split()) for r in corpus.QUERIES["splice_ids"](spark, small).collect()}
    assert got == {i: min(x, 1024) for i, x in n.items()} and max(got.values()) > 96
