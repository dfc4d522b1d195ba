"""WARC archives and token files: round trips, damage, edges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rwspark.llm import token_records as T
from rwspark.llm import warc as W
from rwspark.llm.queries import tokenizer_path


def pages(spark, rows):
    return spark.createDataFrame([(a, u, h, "clash") for a, u, h in rows], "page_id long, url string, html string, record_id string")


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a\r\nb", "same"), (2, "u", "same"), (9, None, None), (3, "u", ""), (4, "u", "é" * 300), (2, "u", "same"), (None, "u", "same"), (7, "u", "x\r\n\r\nWARC/1.1\r\n")]
    paths = W.write(pages(spark, rows), f"file://{tmp_path}/w", chunk=64)
    got = W.read_chunks(spark, paths, chunk=50).collect()
    bodies, ends = {}, []
    for r in sorted(got, key=lambda r: (r.record_id or -1, r.chunk_no)):
        if r.record_type == "response":
            bodies.setdefault(r.record_id, []).append((r.chunk_no, bytes(r.chunk)))
        if r.last:
            ends.append(r)
    assert len(ends) == len(rows) and all(len(r.chunk) <= 50 for r in got)
    assert b"".join(c for _, c in bodies[4]) == "é".encode() * 300 and b"".join(c for _, c in bodies[7]) == rows[7][2].encode()
    want = {(a, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len((h or "").encode())) for a, _, h in rows}
    assert {(r.record_id, r.digest_so_far, r.bytes_so_far) for r in ends} == want
    want = [(0, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "response", 0), (4, "response", 0), (5, "revisit", 2), (7, "response", 0), (9, "revisit", 3)]
    assert sorted((r.record_id or 0, r.record_type, r.refers_to or 0) for r in ends) == want
    kinds = {(r.record_id, r.record_type, r.refers_to) for r in ends}
    assert kinds == {(None, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (7, "response", None), (9, "revisit", 3)}
    text = b"".join(gzip.decompress(Path(p.removeprefix("file://")).read_bytes()) for p in paths)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_warc_chunks_find_their_record(spark, tmp_path, threshold):
    """With and without a shuffle of the chunks: records that share an id, repeat, or have many chunks are whole again."""
    rows = [(i % 7, f"u{i}", f"{i % 5}é" * (i * 40)) for i in range(60)] + [(3, "twice", "same" * 90)] * 3
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, threshold)
    try:
        paths = W.write(pages(spark, rows).repartition(5), f"file://{tmp_path}/w", chunk=64)
        got = W.read_chunks(spark, paths, payloads=False).collect()
    finally:
        spark.conf.set(key, before)
    want = sorted((a, u, base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), len(h.encode())) for a, u, h in rows)
    assert sorted((r.record_id, r.url, r.digest_so_far, r.bytes_so_far) for r in got) == want


def test_warc_least_size(spark):
    got = W.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), least=3)
    assert {(r.record_id, r.record_type) for r in got.collect()} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_warc_damage(spark, tmp_path):
    (path,) = W.write(pages(spark, [(1, "u", "hello")]).coalesce(1), f"file://{tmp_path}/w")
    whole = gzip.decompress(Path(path.removeprefix("file://")).read_bytes())
    Path(path.removeprefix("file://")).write_bytes(gzip.compress(whole.replace(b"hello", b"jello")))
    with pytest.raises(ValueError, match="damaged"):
        list(W.records(path))


def test_empty_tables(spark, docs):
    assert W.round_trip(pages(spark, [])).count() == 0
    assert T.round_trip(docs([]), tokenizer_path).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return T.encoder(tokenizer_path(), 2)


@pytest.fixture(scope="module")
def library():
    """Not the encoder's: as the contract names it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "Wort", "naïve", "é", "漢字", "٣", "12", ".", ",", "'s", "'", " ", "  ", "\n", "\t", " ", "\x1c", "\x00", "###", "<|endoftext|>", "ɐb", "ſ"]), max_size=14).map("".join))
def test_pieces_are_the_whole_text(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids + [2]
    assert list(encoder.stream([text])) == [struct.pack(f"<{len(ids)}H", *ids)]


class Counted(dict):
    """Counts what is asked of it."""

    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def test_a_piece_is_looked_up_once_a_batch(library):
    encode, text = T.Encoder(tokenizer_path(), 2), "some words, and more of them!\n" * 500
    encode.later = Counted()
    ids = library.encode(text[:-1], add_special_tokens=False).ids + [2]
    assert list(encode.stream([text[:-1]] * 3)) == [struct.pack(f"<{len(ids)}H", *ids)] * 3
    assert encode.later.asked < 20  # 9,000 words


def test_texts_of_a_batch_keep_apart(library):
    texts = ["a b.\nc", None, "", "a  b", "<|endoftext|> a", "\n", " a", "a ", "tab\tin it", "a b.\nc", "Don't!? it's... o'.", "é&&& %%% «x», ...", "\na\n\nb", "x" * 50, None, "漢字. ɐb, ſ;"]
    want = [(library.encode(t, add_special_tokens=False).ids if t else []) + [2] for t in texts]
    want = [struct.pack(f"<{len(ids)}H", *ids) for ids in want]
    for most, chars in ((800_000, 4_000_000), (3, 20), (0, 1)):
        encode = T.Encoder(tokenizer_path(), 2, most)
        assert list(encode.stream(texts, chars)) == want and list(encode.stream(texts[::-1], chars)) == want[::-1]


def test_token_files(spark, docs, edge_texts, library, tmp_path):
    rows = [(7, "a <|endoftext|> b", "en", "s")] + [(10 * i, t, "en", "s") for i, t in enumerate(edge_texts)] + [(None, "null id", "en", "s"), (30, "a again", "en", "s")]
    files = T.write(docs(rows, extra=True), f"file://{tmp_path}/t", tokenizer_path)
    ids = lambda t: (library.encode(t, add_special_tokens=False).ids if t else []) + [2]
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want, start = [], 0
    for doc_id, text, *_ in order:
        own = ids(text)
        want.append((doc_id, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
        start += len(own)
    got = sorted(map(tuple, T.read(spark, files).collect()), key=lambda r: r[1])
    assert got == want
    at = 0
    for path, n, _ in files:  # reads out of order, by the index
        for k in reversed(range(n)):
            doc_id, own = T.read_one(path, k)
            assert (doc_id, own) == (order[at + k][0], ids(order[at + k][1]))
        at += n


def test_token_damage(spark, docs, tmp_path):
    ((path, _, _),) = T.write(docs(["some text"]).coalesce(1), f"file://{tmp_path}/t", tokenizer_path)
    file = Path(path.removeprefix("file://") + ".bin")
    data = bytearray(file.read_bytes())
    data[30] ^= 1
    file.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(T.frames(path))
