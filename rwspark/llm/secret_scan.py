"""Secret scans by dictionary-primed Zstandard novelty.

Patterns find assignments, access keys and hex strings. Beside them, every long token near a sensitive word is a
candidate: its marginal size, in bytes, is what it adds to a Zstandard frame whose dictionary is the code and text around
it, identifiers common in code, and the words that are most common in the corpus itself (``corpus_identifiers``, counted over
all texts). What the dictionary can't shorten, and is no name, path or date by its make (``keylike``), is reported.

Nulls and empty texts have no findings. Repeated rows are judged alike, each on its own. A candidate that overlaps a
pattern's span is dropped, so spans of kind ``novel`` never overlap others. Texts of any length are read as a whole; the
window around a candidate only primes the dictionary. Sensitive context is the text within ``reach`` characters, and the lines
that a key runs on to. An empty table gives an empty table. The result has the id and ``findings``; an id column of that name
becomes ``kept_findings``. Other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, per_batch

# The patterns of the three kinds, from the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what is near them sensitive.
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|credential|bearer|authoriz|signature|client.?id|\b(?:api|private|access|aws|ssh|gpg|rsa|account|storage|master|signing|encryption).{0,8}?key|\bkey\x20?[:=]", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=@!$%^&*~#-]{12,}", re.ASCII)
MARKS = set("@!$%^&*~#")
#: Stretches that a name is made of.
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Between tokens on consecutive lines; line breaks may be escaped.
NEXT_LINE = re.compile(r"""["',;+>#*\x20\t]*(?:\r?\n|\\)["',;+>#*\x20\t]*""")

# Identifiers common in code and configuration, for the dictionary.
IDENTIFIERS = """access account action address admin algorithm amazonaws api apikey application args array async auth authorization await aws
base64 basic bearer body bool break bucket buffer build byte cache callback case catch certificate char class client client_id client_secret
cluster code column commit config configuration connect connection const content context continue controller cookie count create credential
credentials crypto data database date debug decode default define delete delimiter deploy description digest dict directory display docker
document domain double driver else email enable encode encoding encrypt endpoint environment error event except exception execute expire export
extends false field file filter final finally float flush format from function generate get getenv github global group handler hash header
headers hostname http https identity implements import include index init input insert instance int integer interface internal item
json key kubernetes label lambda length level library license limit link list local localhost lock log logger login main manager map master
message metadata method mode model module name namespace network node null number object option options order output override package page
param parameter parameters parent parse partition password path pattern payload permission pipeline plugin port postgres prefix print private
private_key process production profile project properties property protected protocol provider proxy public public_key query queue read redis
refresh_token region register release remote remove replace repository request require resource response result return role root route
row sample schema scope script search secret secret_key select self send sequence server service session set sha256 shared signature
size socket source space spark sql ssh staging start state static status stop storage store stream string struct subject submit suffix
super switch system table target task template temporary test text this thread throw time timeout timestamp title token tokens trace transform
true try type undefined unique update upload url user username uuid validate value values var variable version view void while window with
worker write xml yaml yield zone""".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower() if ":" in text or "=" in text else ""
    if low and ("passw" in low or "secret" in low or "token" in low or ("api" in low and "key" in low)):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of a string, given text around it and the identifiers."""

    def __init__(self, identifiers: list[str] | None = None, window: int = 400):
        own = [*(identifiers or ()), *IDENTIFIERS]
        self.known, self.window = " ".join(f"{x} {x.capitalize()}" if x.islower() else x for x in own).encode(), window

    def marginal(self, text: str, start: int, end: int) -> int:
        import zstandard as zs

        around = text[max(0, start - self.window) : start] + " " + text[end : end + self.window]
        primed = zs.ZstdCompressionDict(self.known + around.encode("utf-8", "surrogatepass"), dict_type=zs.DICT_TYPE_RAWCONTENT)
        press = zs.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(press.compress(text[start:end].encode("utf-8", "surrogatepass"))) - len(press.compress(b""))


def keylike(token: str) -> bool:
    """A key by its make: kinds of characters that change every few places, or one long stretch of capitals or of letters and digits.

    Paths, dates and names of releases are short stretches between marks; names of classes are long stretches of letters.
    """
    kinds = [any(a <= c <= b for c in token) for a, b in (("0", "9"), ("a", "z"), ("A", "Z"))]
    if all(kinds) and len(MARKS & set(token)) >= 2:
        return True
    parts = re.findall(r"[A-Za-z0-9]+", token)
    if max(map(len, parts), default=0) < 10 or sum(kinds) == 1 and not (kinds[2] and len(token) >= 20):
        return False
    humps = HUMP.findall(token)
    return len(humps) == 1 or sum(map(len, humps)) <= 3.5 * len(humps)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, block) of long tokens; those on consecutive lines are one block. A sensitive word divides its token."""
    words, found, block, last = [m.span() for m in SENSITIVE.finditer(text)], [], 0, 0
    k = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(words) and words[k][1] <= a:
            k += 1
        parts = [(a, words[k][0]), (words[k][1], b)] if k < len(words) and words[k][0] < b else [(a, b)]
        if not NEXT_LINE.fullmatch(text, last, a):
            block += 1
        found += [(x, y, block) for x, y in parts if y - x >= 12]
        last = b
    return found


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, reach: int = 80, ratio: float = 0.6, least: int = 10) -> list[tuple[int, int, int, int]]:
    """(start, 3, end, marginal bytes) of incompressible tokens within ``reach`` characters of a sensitive word, on either side, and on the lines that such tokens run on to."""
    words, tokens, k, near = [m.span() for m in SENSITIVE.finditer(text)], candidates(text), 0, set()
    for a, b, block in tokens:
        while k < len(words) and words[k][1] + reach < a:
            k += 1
        if k < len(words) and words[k][0] - reach <= b:
            near.add(block)
    found = []
    for start, end, block in tokens:
        if block not in near or not keylike(text[start:end]) or any(a < end and start < b for a, _, b in taken):
            continue
        size = novelty.marginal(text, start, end)
        if size >= max(least, ratio * (end - start)):
            found.append((start, 3, end, size))
    return found


def find(text: str | None, novelty: Novelty) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, marginal bytes) of all findings, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(a, k, b, novelty.marginal(text, a, b)) for a, k, b in base]
    if SENSITIVE.search(text):
        spans += novel_spans(text, base, novelty)
    return sorted(spans)


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = 1000) -> list[str]:
    """The ``most`` most common words of the corpus, as they are written, by grouped counts over all texts; ties by name. That many, at any size, come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(most).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: list[str] | None = None) -> DataFrame:
    """Findings of each row: ``id_col`` and ``findings``, an array of kind, start, end, marginal_bytes and value.

    A map over the rows: no shuffle, no state between rows. ``identifiers`` join the fixed ones, those of the corpus if not given.
    """
    identifiers = corpus_identifiers(docs, text_col) if identifiers is None else identifiers

    def make(batch: pa.RecordBatch, novelty: Novelty) -> list:
        out = []
        for text in batch.column(1).to_pylist():
            out.append([{"kind": KINDS[k], "start": a, "end": b, "marginal_bytes": size, "value": text[a:b]} for a, k, b, size in find(text, novelty)])
        return [batch.column(0), out]

    kind, (name,) = dict(docs.dtypes)[id_col], free_names([id_col], ["findings"])
    schema = f"`{name}` {kind}, findings array<struct<kind: string, start: bigint, end: bigint, marginal_bytes: bigint, value: string>>"
    return per_batch(docs.select(id_col, text_col), schema, make, lambda: Novelty(identifiers))
