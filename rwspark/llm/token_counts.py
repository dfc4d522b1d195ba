"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

The vocabulary is that of a public model; a piece's unigram score follows Zipf's law from its place in the vocabulary.
Pre-tokens are words between ASCII white space behind a word mark. The new distinct pre-tokens of a batch, in order, visit
their trie depth first: a node's forward score (the best score of any segmentation up to it) and its count of tokens are
computed once, kept on a stack for all pre-tokens that share the prefix, and stored at the terminals. A text's count is the
sum over its pre-tokens' terminals. Characters that no piece covers are tokens byte by byte.

Null and empty texts have no pre-tokens and no tokens. Repeated rows are counted alike, each on its own. Equal scores go to
fewer tokens. Words of any length are scored; a worker's store of terminals is bounded and starts anew when full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, utf8

MARK = "▁"


class Unigram:
    """Scores of pieces, and counts of tokens of pre-tokens."""

    def __init__(self, pieces: list[str], most: int = 600_000):
        total = math.log(sum(1 / (rank + 2.7) for rank in range(len(pieces))))
        self.score = {piece: -math.log(rank + 2.7) - total for rank, piece in reversed(list(enumerate(pieces))) if piece}
        self.longest = max(map(len, self.score), default=1)
        self.byte = -math.log(len(pieces) + 2.7) - total - 5.0
        self.terminals: dict[bytes, int] = {}
        self.most, self.nodes = most, 0

    @classmethod
    def load(cls, path: str) -> "Unigram":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))])

    def walk(self, tokens: list[str]) -> list[int]:
        """Counts of sorted distinct pre-tokens; nodes of the trie that they share are scored once."""
        get, longest = self.score.get, self.longest
        best, count, last, out = [0.0], [0], "", []
        for token in tokens:
            at, most = 0, min(len(last), len(token))
            while at < most and last[at] == token[at]:
                at += 1
            del best[at + 1 :], count[at + 1 :]
            for end in range(at + 1, len(token) + 1):
                extra = len(token[end - 1].encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + extra * self.byte, count[end - 1] + extra
                for start in range(max(0, end - longest), end):
                    own = get(token[start:end])
                    if own is not None:
                        score = best[start] + own
                        if score > top or score == top and count[start] + 1 < n:
                            top, n = score, count[start] + 1
                best.append(top)
                count.append(n)
                self.nodes += 1
            out.append(count[-1])
            last = token
        return out

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        split = [text.split() for text in texts]
        if len(self.terminals) > self.most:
            self.terminals.clear()
        new = sorted((MARK + word.decode("utf-8", "surrogatepass"), word) for word in set().union(*split) - self.terminals.keys())
        self.terminals.update(zip((word for _, word in new), self.walk([token for token, _ in new])))
        return [(len(words), sum(map(self.terminals.__getitem__, words))) for words in split]


_MODELS: dict[str, Unigram] = {}


def counted(docs: DataFrame, vocabulary: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", chars: int = 2_000_000) -> DataFrame:
    """id_col, n_pretokens and n_tokens of each row. A map over the rows: no shuffle. vocabulary: a model file's path, the same on all executors, or what gives it."""

    def setup() -> Unigram:
        path = vocabulary() if callable(vocabulary) else vocabulary
        if path not in _MODELS:
            _MODELS[path] = Unigram.load(path)
        return _MODELS[path]

    def make(batch: pa.RecordBatch, model: Unigram) -> list:
        texts, out, at = batch.column(1).to_pylist(), [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= chars):
                held += len(texts[to])
                to += 1
            out += model.counts(texts[at:to])
            at = to
        return [batch.column(0), [n for n, _ in out], [n for _, n in out]]

    kind = dict(docs.dtypes)[id_col]
    return per_batch(docs.select(id_col, utf8(text_col).alias("text")), f"`{id_col}` {kind}, n_pretokens bigint, n_tokens bigint", make, setup)
