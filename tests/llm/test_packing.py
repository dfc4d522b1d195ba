from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import pytest

from rwspark.llm import packing as P
from rwspark.llm import queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def held(windows, rows, library, end_id=0):
    """Checks that windows are full and gapless, and hold each id of each document once."""
    found, sizes = defaultdict(list), []
    assert len({w.sequence_id for w in windows}) == len(windows)
    for w in windows:
        ids, at = struct.unpack(f"<{len(w.ids) // 4}I", w.ids), 0
        assert len(ids) == w.context and w.context & (w.context - 1) == 0 and w.context <= 1024
        for p in w.pieces:
            assert p.offset == at and p.length > 0
            found[p.doc_id, p.doc_tokens].append((p.start, ids[at : at + p.length]))
            at += p.length
        assert at == w.context
        sizes.append(w.context)
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = (*library.encode(text or "", add_special_tokens=False).ids, end_id)
        want[doc_id, len(ids)].append(ids)
    assert found.keys() == want.keys()
    for key, texts in want.items():
        every = [x for ids in texts for x in ids]
        assert sorted(x for _, ids in found[key] for x in ids) == sorted(every)
        if len(texts) == 1:
            assert [x for _, ids in sorted(found[key]) for x in ids] == every
            assert all(a == sum(len(i) for _, i in sorted(found[key])[:k]) for k, (a, _) in enumerate(sorted(found[key])))
    return sizes


def test_windows_hold_all_documents(spark, docs, library, edge_texts):
    texts = [*edge_texts, *("word and other " * k for k in range(0, 700, 7)), "<|endoftext|> a", None]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "no id", "en", "s"), (3, "one", "en", "s"), (3, "one", "en", "s")]
    for pool in (1, 3_000, 1 << 20):
        windows = P.sequences(docs(rows, extra=True).coalesce(1), queries.tokenizer_path, pool=pool).collect()
        sizes = held(windows, [(a, t) for a, t, _, _ in rows], library)
        assert sum(c < 64 for c in sizes) <= 6
    whole = sum(len(w.pieces) for w in windows)
    assert whole < 1.5 * (len(rows) + sum(sizes) / 1024)  # few documents are cut but by the longest window


def test_step_groups_are_balanced(spark, docs):
    windows = P.sequences(docs(["some words to pack " * (k % 400) for k in range(500)]).coalesce(1), queries.tokenizer_path, step=1 << 14).collect()
    groups = defaultdict(int)
    for w in windows:
        groups[w.step] += w.context
    assert len(groups) > 5 and max(groups.values()) - min(groups.values()) <= 1024
    assert P.steps([64] * 5 + [1024, 512], 1 << 20) == [0] * 7 and P.steps([], 5) == []


def test_short_documents_fill_gaps():
    import numpy as np

    pool = P.Pool()
    for k, n in enumerate((700, 300, 24, 500, 12)):
        pool.add((k, n), 0, np.zeros(n, np.int64))
    windows = list(P.packed(pool, (512, 1024), False))
    assert [(c, [(p[2][0], p[3], p[0]) for p in ps]) for c, ps in windows] == [(1024, [(0, 0, 700), (1, 0, 300), (2, 0, 24)]), (512, [(3, 0, 500), (4, 0, 12)])]


def test_empty_table_and_wrong_contexts(spark, docs):
    assert P.sequences(docs([]), queries.tokenizer_path).count() == 0
    for wrong in ((), (100,), (128, 64)):
        with pytest.raises(ValueError):
            P.sequences(docs([]), queries.tokenizer_path, contexts=wrong)


def test_query(spark, small, library):
    got = queries.QUERIES["op13_packing"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for doc_id in ids:
        spans = sorted((r.start, r.length) for r in got if r.doc_id == doc_id)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
