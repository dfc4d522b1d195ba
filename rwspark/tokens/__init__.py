"""Sub-word tokenizers as columns: ids, character offsets and word marks of texts, and what is built on them.

A tokenizer is named by a ``Spec``, which travels with the tasks; each Python process loads it once and encodes Arrow batches.
All that follows an encoding (slices of chunks, boundaries, chunks of ids) is native: arrays of a row, no Python.

Null texts give null; empty ones empty arrays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rwspark import functions as R

ENCODED = "struct<ids: array<int>, starts: array<int>, ends: array<int>, heads: array<boolean>>"


class Encoded(NamedTuple):
    """Of one text: ids, the characters start..end-1 that each stands for, and whether it begins a word."""

    ids: list[int]
    starts: list[int]
    ends: list[int]
    heads: list[bool]


class Tokenizer(Protocol):
    """What a tokenizer has to do; no special tokens are added."""

    def encode(self, texts: list[str]) -> list[Encoded]: ...

    def decode(self, ids: list[list[int]]) -> list[str]: ...


def word_starts(text: str, starts: list[int], ends: list[int]) -> list[bool]:
    """Whether a token's first character that is no white space comes after white space, or first."""
    found = []
    for a, b in zip(starts, ends):
        while a < b and text[a].isspace():
            a += 1
        found.append(a < b and (a == 0 or text[a - 1].isspace()))
    return found


class Library:
    """A file of the ``tokenizers`` library. ``mark`` begins the pieces that begin words; without one, offsets tell."""

    def __init__(self, path: str, mark: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Loaded

        self.own, self.mark = Loaded.from_file(path), mark

    def encode(self, texts: list[str]) -> list[Encoded]:
        out = []
        for text, x in zip(texts, self.own.encode_batch(texts, add_special_tokens=False)):
            starts, ends = [a for a, _ in x.offsets], [b for _, b in x.offsets]
            out.append(Encoded(x.ids, starts, ends, [p.startswith(self.mark) for p in x.tokens] if self.mark else word_starts(text, starts, ends)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.own.decode_batch(ids, skip_special_tokens=True)


class Pieces:
    """A model of the ``sentencepiece`` library; U+2581 begins the pieces that begin words."""

    def __init__(self, path: str, mark: str | None = "▁"):
        import sentencepiece

        self.own, self.mark = sentencepiece.SentencePieceProcessor(model_file=path), mark or "▁"

    def encode(self, texts: list[str]) -> list[Encoded]:
        out = []
        for text in texts:
            pieces = self.own.encode(text, return_type="proto").pieces
            place = None if text.isascii() else [0, *accumulate(int(byte & 0xC0 != 0x80) for byte in text.encode())]  # the library counts bytes
            starts, ends = ([x if place is None else place[x] for x in side] for side in ([p.begin for p in pieces], [p.end for p in pieces]))
            out.append(Encoded([p.id for p in pieces], starts, ends, [p.piece.startswith(self.mark) for p in pieces]))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.own.decode(ids)


class Hashed:
    """Model-free: runs of ASCII letters and digits, other characters one by one, ids from a hash; it can't decode. The same as ``functions.pieces`` and ``word_id``."""

    PIECE = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", re.ASCII)

    def __init__(self, path: str = "", mark: str | None = None):
        self.known: dict[str, int] = {}

    def id(self, piece: str) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        if piece not in self.known:
            self.known[piece] = int(hashlib.md5(piece.encode()).hexdigest()[:8], 16) % 50000 + 10
        return self.known[piece]

    def encode(self, texts: list[str]) -> list[Encoded]:
        out = []
        for text in texts:
            spans = [m.span() for m in self.PIECE.finditer(text)]
            starts, ends = [a for a, _ in spans], [b for _, b in spans]
            out.append(Encoded([self.id(text[a:b]) for a, b in spans], starts, ends, word_starts(text, starts, ends)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        raise ValueError("hashed ids have no text")


KINDS: dict[str, Callable[..., Tokenizer]] = {"library": Library, "pieces": Pieces, "hashed": Hashed}


@dataclass(frozen=True)
class Spec:
    """Names a tokenizer: its kind, the path of its file (or what gives it, where the executors' path differs), and the mark that begins words."""

    kind: str = "hashed"
    path: str | Callable[[], str] = ""
    mark: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown tokenizer {self.kind}; there are {', '.join(sorted(KINDS))}")


_LOADED: dict[tuple, Tokenizer] = {}


def loaded(spec: Spec) -> Tokenizer:
    """One for each process."""
    key = (spec.kind, spec.path() if callable(spec.path) else spec.path, spec.mark)
    if key not in _LOADED:
        _LOADED[key] = KINDS[spec.kind](key[1], spec.mark)
    return _LOADED[key]


def few(texts: pa.Array, most: int = 64, characters: int = 200_000) -> Iterator[tuple[int, int]]:
    """Stretches of a batch, their starts and sizes: of at most ``most`` texts, and of so many characters in all unless one has more."""
    at, held = 0, 0
    for k, size in enumerate(pc.utf8_length(texts).to_pylist()):
        if k > at and (k - at >= most or held + (size or 0) > characters):
            yield at, k - at
            at, held = k, 0
        held += size or 0
    if len(texts) > at:
        yield at, len(texts) - at


def encoded(text: Column, spec: Spec) -> Column:
    """ids, starts, ends and heads of a text."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("heads", pa.list_(pa.bool_()))])

    @F.arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        parts = []
        for at, size in few(texts):  # an encoding takes far more memory than its text
            values = texts.slice(at, size).to_pylist()
            found = iter(loaded(spec).encode([x for x in values if x is not None]))
            parts.append(pa.array([None if x is None else next(found)._asdict() for x in values], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encode(text)


def decoded(rows: DataFrame, ids: str, out: str, spec: Spec) -> DataFrame:
    """``rows`` with ``out``, the texts of the lists of ids in a column, without special tokens and white space at the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(ids).to_pylist()
            found = iter(loaded(spec).decode([x for lists in values for x in lists or ()]))
            texts = [None if lists is None else [next(found).strip() for _ in lists] for lists in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(out, ArrayType(StringType()))]))


def of_words(text: str, whole: Encoded) -> list[list[int]]:
    """Ids of the words of a text by its tokens' offsets: the word of the middle character; a token of white space belongs to the word after it, or the last."""
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    spans: list[list[int]] = [[] for _ in ends]
    at = 0
    for token, a, b in zip(whole.ids, whole.starts, whole.ends):
        while at < len(ends) - 1 and (a + b) // 2 >= ends[at]:
            at += 1
        spans[at].append(token)
    return spans


def of_characters(text: str, whole: Encoded) -> list[list[int]]:
    """Ids of the characters of a text: a token belongs to the character that it starts with."""
    spans: list[list[int]] = [[] for _ in text]
    for token, a in zip(whole.ids, whole.starts):
        spans[min(a, len(text) - 1)].append(token)
    return spans


def spans(texts: list[str], cjk: list[bool], tokenizer: Tokenizer) -> list[list[list[int]]]:
    """Ids of each word (or character, of a language without spaces) of texts; laid end to end they are the ids of the whole text.

    Words are encoded one by one, each distinct one once, the first without and the others with a space before them; where that
    doesn't give the ids of the whole text, the offsets decide.
    """
    cleaned = [t.replace(" ", "") if c else t for t, c in zip(texts, cjk)]
    parts = [list(t) if c else [w if k == 0 else " " + w for k, w in enumerate(t.split())] for t, c in zip(cleaned, cjk)]
    distinct = list({p for x in parts for p in x})
    known = dict(zip(distinct, (x.ids for x in tokenizer.encode(distinct))))
    out = []
    for text, c, own, whole in zip(cleaned, cjk, parts, tokenizer.encode(cleaned)):
        found = [known[p] for p in own]
        if [i for x in found for i in x] != whole.ids:
            found = (of_characters if c else of_words)(text, whole) if own else []
        out.append(found)
    return out


def word_spans(text: Column, lang: Column, spec: Spec) -> Column:
    """Of each word of a text its ids, an array of arrays; of each character where ``lang`` has no spaces between words. A text of white space has no words."""

    @F.arrow_udf("array<array<int>>")
    def span(texts: pa.Array, cjk: pa.Array) -> pa.Array:
        parts, kind = [], pa.list_(pa.list_(pa.int32()))
        for at, size in few(texts):
            values = texts.slice(at, size).to_pylist()
            rows = [(x, bool(c)) for x, c in zip(values, cjk.slice(at, size).to_pylist()) if x is not None]
            found = iter(spans([x for x, _ in rows], [c for _, c in rows], loaded(spec)))
            parts.append(pa.array([None if x is None else next(found) for x in values], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return span(text, F.coalesce(R.is_cjk(lang), F.lit(False)))


# Native: arrays of a row.


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slices(ids: Column, stops: Column) -> Column:
    """Parts of an array that end before each of ``stops``, which ascend."""

    def cut(all: Column) -> Column:
        start = lambda k: F.coalesce(F.get(all, k - 1), F.lit(0))
        return F.transform(all, lambda stop, k: F.slice(ids, start(k) + 1, stop - start(k)))

    return R.bound(stops, cut)


def chunk_slices(text: Column, chunks: Column, tokens: Column) -> Column:
    """Ids of each chunk of a text, from its ``encoded`` tokens: chunks are found one after another, and a token belongs to the chunk that its last character is in.

    What follows the last chunk joins it. Null where a chunk isn't found or gets no token, or tokens are left over with no chunk.
    """
    places = R.char_spans(text, F.transform(chunks, stripped))
    upto = F.transform(places, lambda p: F.size(F.filter(tokens["ends"], lambda e: e <= p["stop"])))
    glued = R.bound(upto, lambda all: F.transform(all, lambda stop, k: F.when(k == F.size(all) - 1, F.size(tokens["ids"])).otherwise(stop)))
    bad = lambda found: F.exists(found, lambda x: F.size(x) == 0) | ((F.size(found) == 0) & (F.size(tokens["ids"]) > 0))
    return R.bound(slices(tokens["ids"], glued), lambda found: F.when(~bad(found), found))


def boundaries(tokens: Column, lang: Column) -> Column:
    """Positions before which a source may be cut: where a word begins, and the end; all of them in a language without spaces."""
    n = F.size(tokens["ids"])
    free = F.coalesce(R.is_cjk(lang), F.lit(False))
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (free | (i == n) | F.get(tokens["heads"], i)))


def snapped(commit: Column, tokens: Column, lang: Column) -> Column:
    """The first boundary at or after a commit; 0 and what is beyond the end stay."""
    n = F.size(tokens["ids"])
    later = F.array_position(F.slice(tokens["heads"], commit + 1, F.greatest(n - commit, F.lit(0))), True).cast("int")
    return F.when((commit <= 0) | (commit >= n) | F.coalesce(R.is_cjk(lang), F.lit(False)), commit).when(later == 0, n).otherwise(commit + later - 1)


def id_chunks(commits: Column, source: Column, target: Column, lang: Column, snap: bool = True) -> Column:
    """source_chunk_ids and target_chunk_ids from the monotone commits of the target's tokens.

    Target tokens of one commit are a chunk. With ``snap`` commits go on to the next boundary first, and tokens that commit
    before anything is read belong to no chunk. The last chunk takes the rest of the source; where there is none but that
    rest, it is a chunk without target.
    """
    n, ids = F.size(source["ids"]), source["ids"]
    at = F.transform(commits, lambda c: snapped(c, source, lang)) if snap else commits
    shape = lambda s, t: F.struct(s.alias("source_chunk_ids"), t.alias("target_chunk_ids"))

    def made(counted: Column, ends: Column) -> Column:
        stops = F.transform(ends, lambda e, k: F.when(k == F.size(ends) - 1, n).otherwise(e))
        upto = F.transform(ends, lambda e: F.size(F.filter(counted, lambda x: x <= e)))
        own = F.slice(target["ids"], F.size(commits) - F.size(counted) + 1, F.size(counted))
        unread = (F.size(ends) == 0) & (F.size(commits) > 0) & (n > 0)
        return F.when(unread, shape(F.array(ids), F.array(F.slice(ids, 1, 0)))).otherwise(shape(slices(ids, stops), slices(own, upto)))

    counted = F.filter(at, lambda x: x > 0) if snap else at  # each list is made once
    return R.bound(counted, lambda c: R.bound(F.array_distinct(c), lambda ends: made(c, ends)))


def texts_of(text: Column, tokens: Column) -> Column:
    """The text of each token, by its offsets."""
    return F.zip_with(tokens["starts"], tokens["ends"], lambda a, b: F.substring(text, a + 1, b - a))


def token_pairs(pairs: DataFrame, spec: Spec, most: int = 80) -> DataFrame:
    """Pairs (id, source, target and others) with ``source_tokens`` and ``target_tokens``, their texts s and t and numbers n and m; 1 <= n <= ``most``, m > 0. What annotation takes."""
    rows = pairs.withColumn("source_tokens", encoded(F.col("source"), spec))
    rows = rows.withColumn("n", F.size("source_tokens.ids")).filter(F.col("n").between(1, most))
    rows = rows.withColumn("target_tokens", encoded(F.col("target"), spec)).withColumn("m", F.size("target_tokens.ids")).filter("m > 0")
    return rows.withColumn("s", texts_of(F.col("source"), F.col("source_tokens"))).withColumn("t", texts_of(F.col("target"), F.col("target_tokens")))
