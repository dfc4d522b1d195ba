"""Token ids in length-delimited binary files with masked checksums, and an index of offsets beside each file.

File: ``RWTOKENS``, version and bytes per id (two unsigned 32-bit integers), then a frame per document:
length of the payload (unsigned 64 bit), masked CRC-32 of these eight bytes, the payload, masked CRC-32 of the payload;
all little-endian. Payload: the document's ids of 2 bytes where the vocabulary allows, else 4. Masked: rotated right by 15
bits plus a constant, so that a checksum over data holding checksums stays sound. Index: for each frame the document's id,
the offset of the frame and its number of ids, three 64-bit integers, for shuffled reads.

Documents are dealt to files by ranges of their id, so that the files in order hold all documents in ascending order.
Null texts are empty documents with the end id only; null ids come first (``NULL_ID`` in the index); repeated ids stay
side by side, by text. An empty table gives no frames. Texts of any length are one frame.
"""

from __future__ import annotations

import contextlib
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise
from string import punctuation

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .files import committed, filesystem, opened

MAGIC, VERSION, NULL_ID = b"RWTOKENS", 1, -(2**63)
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


# The bytes that byte-level vocabularies show as they are; the others are numbered from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_TABLE = "".join(_SHOWN.get(b, chr(b)) for b in range(256))


class Encoder:
    """Ids of texts as little-endian bytes.

    The tokenizer's pattern never joins a character that is no white space with the white space after it, so a text is cut at
    single spaces and line feeds, and each distinct piece of a batch is encoded by the library once and kept; Arrow finds the
    distinct pieces and lines their ids up. Where a piece is empty, holds other white space or can't be printed, or the text
    holds a special token's string, the library encodes the whole text.
    """

    def __init__(self, path: str, end_id: int | None, most: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Strings that the library takes for special tokens wherever they stand: texts that hold one are left to it.
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if max(self.library.get_vocab_size(), (end_id or 0) + 1) <= 65536 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.model = self.library.model
        kind = repr(self.library.pre_tokenizer)
        self.by_piece = self.library.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        self.end = b"" if end_id is None else end_id.to_bytes(self.width, "little")
        #: Ids of pieces that begin a text or a line, of those after a space, and of marks after a letter.
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.feed = self.ids(["\n"])[0]
        self.most = most

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        """Ids of a piece: the library's own steps, without what an encoding of a whole text brings along."""
        if text.lstrip(" ").isalpha() and (text.isascii() or max(text) < "ɐ"):  # one word of Latin letters
            ids = [x.id for x in self.model.tokenize(charmap_decode(text.encode(), "strict", _TABLE)[0])]
        else:
            ids = [x.id for part, _ in self.library.pre_tokenizer.pre_tokenize_str(text) for x in self.model.tokenize(part)]
        return array(self.kind, ids).tobytes()

    def learn(self, known: dict[str, bytes], piece: str, before: str) -> bytes | None:
        """Ids of a piece that isn't known; None where only the whole text settles them."""
        if not piece or not piece.isprintable():
            return None
        word = piece.rstrip(punctuation)
        if len(word) < len(piece) and word[-1:].isalpha() and word[-1] < "ɐ":  # the marks after a letter are a part of their own
            marks = piece[len(word) :]
            if marks not in self.marks:
                self.marks[marks] = self.piece(marks)
            ids = (known.get(word) or self.learn(known, word, before)) + self.marks[marks]
        else:
            ids = self.piece(before + piece)
        known[piece] = ids
        return ids

    def line(self, piece: str) -> bytes | None:
        """As learn, of a piece that follows a line feed."""
        if (ids := self.first.get(piece[1:]) or self.learn(self.first, piece[1:], "")) is not None:
            self.later[piece] = ids = self.feed + ids
        return ids

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids, then the end id."""
        if not self.by_piece:
            return [x + self.end for x in self.ids([text or "" for text in texts])]
        if len(self.later) + len(self.first) + len(self.marks) > self.most:
            self.first.clear()
            self.later.clear()
            self.marks.clear()
        # The first line begins with a line feed like the others; its ids are cut off again.
        split = pc.split_pattern(pa.array(["\n" + (text or "").replace("\n", " \n") for text in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        codes, starts, pieces = coded.indices.to_numpy(), split.offsets.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.later.get, pieces))
        for k, (piece, ids) in enumerate(zip(pieces, found)):
            if ids is None:
                found[k] = self.line(piece) if piece[:1] == "\n" else self.learn(self.later, piece, " ")
        found = pa.array(found, pa.large_binary())
        unsettled = starts.searchsorted(found.is_null().to_numpy(zero_copy_only=False)[codes].nonzero()[0], "right") - 1
        whole = {*unsettled.tolist(), *(k for k, text in enumerate(texts) if text and any(x in text for x in self.special))}
        _, places, data = found.take(coded.indices).buffers()
        at, data, out = memoryview(places).cast("q"), memoryview(data or b""), []
        for k, (a, b) in enumerate(pairwise(starts.tolist())):
            own = self.ids([texts[k] or ""])[0] if k in whole else data[at[a] + len(self.feed) : at[b]].tobytes()
            out.append(own + self.end)
        return out

    def stream(self, texts: list[str | None], chars: int = 4_000_000) -> Iterator[bytes]:
        """As batch, by bounded pieces of the list."""
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to] or "") <= chars):
                held += len(texts[to] or "")
                to += 1
            yield from self.batch(texts[at:to])
            at = to


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """One for each process: its pieces serve the tasks that follow."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write(docs: DataFrame, folder: str, tokenizer: str | Callable[[], str], end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> list[tuple[str, int, int]]:
    """Write all documents; the files in order, each with its documents and ids. tokenizer: a file's path, the same on all executors, or what gives it.

    Documents are dealt and sorted by id. With ``stored`` they are in the order of the files that ``docs`` reads (of Parquet,
    by Spark) and of the rows in them: each task writes a file for each run of rows that it is given, and nothing is moved.
    """
    own = (F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if stored:
        name = F.col("_metadata.file_name")
        rows = docs.select(*own, F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0)).alias("part"), name.alias("file"), F.col("_metadata.row_index").alias("row"))
    else:
        rows = docs.select(*own).repartitionByRange("id").sortWithinPartitions("id", "text")
        rows = rows.select("id", "text", F.spark_partition_id().cast("long").alias("part"), F.lit("").alias("file"), F.lit(None).cast("long").alias("row"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        """Of each run of rows its place, and its batches one by one."""
        import numpy as np

        last = None
        for batch in batches:
            part, row = batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            file = batch.column(3).dictionary_encode().indices.to_numpy()
            new = np.flatnonzero((part[1:] != part[:-1]) | (file[1:] != file[:-1]) | ((row[1:] != row[:-1] + 1) & stored)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if a < b:
                    name, at = batch.column(3)[a].as_py(), int(row[a]) if stored else 0
                    if last is None or last[:2] != (int(part[a]), name) or stored and last[2] != at:
                        yield (int(part[a]), name, at), None
                    yield None, batch.slice(a, b - a)
                    last = (int(part[a]), name, at + b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer() if callable(tokenizer) else tokenizer, end_id)
        done, open_files, place, n, total, at = [], contextlib.ExitStack(), None, 0, 0, 16
        out = index = None
        for start, batch in runs(batches):
            if start is not None:
                if place is not None:
                    done.append((*place, n, total))
                open_files.close()
                place, n, total, at = start, 0, 0, 16
                out, index = (open_files.enter_context(committed(folder, f"{file_name(*place)}.{kind}")) for kind in ("bin", "idx"))
                out.write(MAGIC + struct.pack("<II", VERSION, encode.width))
                continue
            for doc_id, payload in zip(batch.column(0).to_pylist(), encode.stream(batch.column(1).to_pylist())):
                out.write(framed := frame(payload))
                index.write(struct.pack("<qqq", NULL_ID if doc_id is None else doc_id, at, len(payload) // encode.width))
                at, n, total = at + len(framed), n + 1, total + len(payload) // encode.width
        if place is not None:
            done.append((*place, n, total))
        open_files.close()
        columns = list(zip(*done)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "file", "row", "documents", "ids"])

    files = rows.mapInArrow(run, "part long, file string, row long, documents long, ids long").collect()  # a row for each file
    return [(f"{folder}/{file_name(x.part, x.file, x.row)}", x.documents, x.ids) for x in sorted(files)]


def file_name(part: int, file: str, row: int) -> str:
    return f"tokens-{part:06d}" + (f"-{zlib.crc32(file.encode()):08x}-{row:012d}" if file else "")


def frames(path: str) -> Iterator[tuple[int | None, bytes, int]]:
    """(document id, payload, bytes per id) of a file, checked."""
    with opened(path + ".bin") as data, opened(path + ".idx") as index:
        magic, version, width = struct.unpack("<8sII", data.read(16))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path}: not a token file of version {VERSION}")
        at = 16
        while entry := index.read(24):
            doc_id, offset, n = struct.unpack("<qqq", entry)
            length, crc = struct.unpack("<QI", data.read(12))
            payload = data.read(length)
            if offset != at or n * width != length or crc != masked(struct.pack("<Q", length)) or struct.unpack("<I", data.read(4))[0] != masked(payload):
                raise ValueError(f"{path}: damaged at byte {at}")
            at += 16 + length
            yield None if doc_id == NULL_ID else doc_id, payload, width
        if data.read(1):
            raise ValueError(f"{path}: frames that the index lacks")


def read_one(path: str, k: int) -> tuple[int | None, list[int]]:
    """Document id and ids of the k-th frame of a file, by the index: a read out of order touches one entry and one frame."""
    (store, name), (_, idx) = filesystem(path + ".bin"), filesystem(path + ".idx")
    with store.open_input_file(idx) as index, store.open_input_file(name) as data:
        width = struct.unpack("<8sII", data.read(16))[2]
        index.seek(24 * k)
        doc_id, offset, n = struct.unpack("<qqq", index.read(24))
        data.seek(offset + 12)
        payload = data.read(n * width)
        if struct.unpack("<I", data.read(4))[0] != masked(payload):
            raise ValueError(f"{path}: damaged at byte {offset}")
        return None if doc_id == NULL_ID else doc_id, list(struct.unpack(f"<{n}{'H' if width == 2 else 'I'}", payload))


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers) from the files; a task for each file."""
    starts = [0, *accumulate(ids for _, _, ids in files)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for k in batch.column(0).to_pylist():
                start, rows = starts[k], []
                for doc_id, payload, width in frames(files[k][0]):
                    n = len(payload) // width
                    ids = payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()
                    rows.append((doc_id, start, n, zlib.crc32(ids)))
                    start += n
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    if not files:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int | None = 2, stored: bool = False) -> DataFrame:
    """Written to the shared folder, then read."""
    return read(docs.sparkSession, write(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id, stored=stored))
