"""Language identification by Bayesian evidence fusion.

A naive Bayes model of letter trigrams, fitted on a bounded sample of labelled texts, gives each page's text likelihoods.
The text posteriors, as soft counts, are summed by grouped aggregation into how often a language declares which markup
language, stands behind which address suffix, and is used by a host; a host's prior is smoothed towards its domain's, and
this towards all pages'. The page's own soft count is taken out of its host's. Likelihoods and priors are then multiplied.

Null and empty pages have no text evidence and are judged by the rest; null addresses have an empty host. Ties go to the
language first by name. Repeated pages are judged alike and all count. An empty table gives no rows; without labelled texts
there is no language to choose from, and this raises an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, per_batch, written
from .html_extract import extract

DECLARED = r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})"


def trigrams(word: str) -> list[str]:
    word = f" {word} "
    return [word[i : i + 3] for i in range(len(word) - 2)]


LETTERS = re.compile(r"[^\W\d_]+")


def fitted(labelled: DataFrame, train_rows: int = 4000, features: int = 20_000) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Languages, log likelihoods of trigrams by language, and that of any other trigram.

    ``train_rows`` rows, by a hash of their id, are the sample; the commonest ``features`` trigrams are the model. Both are
    bounds on what reaches the driver.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sample = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(sample.distinct()), "doc_id", "left_semi")

    def make(batch: pa.RecordBatch) -> list:
        counts: Counter = Counter()
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            for word, n in Counter(LETTERS.findall(text.lower())).items():
                for gram in trigrams(word):
                    counts[lang, gram] += n
        return [[lang for lang, _ in counts], [gram for _, gram in counts], list(counts.values())]

    grams = written(per_batch(sample.select("lang", "text"), "lang string, gram string, n long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        raise ValueError("no labelled texts to fit languages on")
    common = grams.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(features)
    found: dict[str, dict[str, int]] = {}
    for r in grams.join(F.broadcast(common), "gram", "left_semi").collect():
        found.setdefault(r.gram, {})[r.lang] = r.n
    langs = sorted(totals)
    logs = lambda by: [math.log((by.get(lang, 0) + 0.5) / (totals[lang] + 0.5 * (len(found) + 1))) for lang in langs]
    return langs, {gram: logs(by) for gram, by in found.items()}, logs({})


class Likelihoods:
    """Log likelihoods of texts; a word's trigrams are summed once."""

    def __init__(self, model: dict[str, list[float]], other: list[float]):
        self.model, self.other = model, other
        self.words: dict[str, tuple[float, ...]] = {}

    def word(self, word: str) -> tuple[float, ...]:
        own = self.words.get(word)
        if own is None:
            if len(self.words) > 200_000:
                self.words.clear()
            own = self.words[word] = (float(len(word)), *(sum(x) for x in zip(*(self.model.get(gram, self.other) for gram in trigrams(word)))))
        return own

    def __call__(self, text: str, trust: float) -> list[float]:
        """Scaled as if a text had at most about ``trust`` independent trigrams, less the largest."""
        if not (words := LETTERS.findall(text.lower())):
            return [0.0] * len(self.other)
        n, *sums = map(sum, zip(*map(self.word, words)))
        top = max(sums)
        return [(x - top) * trust / (trust + n) for x in sums]


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def _scored(rows: DataFrame, model: tuple, trust: float, read) -> DataFrame:
    """The last column, a text that ``read`` makes plain, becomes logs: text log likelihoods by language."""
    langs, grams, other = model
    grams = rows.sparkSession.sparkContext.broadcast(grams)  # bounded by the model's features
    *keep, _ = rows.dtypes

    def make(batch: pa.RecordBatch, score: Likelihoods) -> list:
        return [*batch.columns[:-1], [score(read(text), trust) for text in batch.columns[-1].to_pylist()]]

    return per_batch(rows, "".join(f"`{c}` {kind}, " for c, kind in keep) + "logs array<double>", make, lambda: Likelihoods(grams.value, other))


def page_evidence(pages: DataFrame, model: tuple, trust: float = 30.0) -> DataFrame:
    """page_id, url, logs, declared, host, domain, suffix."""

    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = _scored(pages.select("page_id", "url", declared.alias("declared"), "html"), model, trust, extract)
    names = F.split("host", r"\.")
    return rows.withColumn("host", host).withColumn("suffix", F.element_at(names, -1)).withColumn("domain", F.array_join(F.slice(names, -F.least(F.size(names), F.lit(2)), 2), "."))


def document_evidence(docs: DataFrame, model: tuple, trust: float = 30.0) -> DataFrame:
    """doc_id, logs, and the source as host; documents declare nothing and have no address. Their ``lang`` isn't read."""
    rows = _scored(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "text"), model, trust, lambda text: text or "")
    return rows.withColumn("domain", F.col("host")).withColumn("declared", F.lit("")).withColumn("suffix", F.lit(""))


def identified(rows: DataFrame, langs: list[str], strength: float = 5.0) -> DataFrame:
    """Rows of evidence with lang, confidence and text_lang, without logs, domain and suffix."""
    every, keep = range(len(langs)), [c for c in rows.columns if c not in ("logs", "domain", "suffix")]
    rows = written(rows.withColumn("soft", _softmax(F.col("logs"))), "evidence")
    sums = lambda by: written(rows.groupBy(*by).agg(*(F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in every)), "soft")
    vector = lambda name: F.array(*(F.col(f"s{i}") for i in every)).alias(name)
    total = rows.agg(*(F.coalesce(F.sum(F.get("soft", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in every)).select(vector("all"))
    out = rows.crossJoin(F.broadcast(written(total, "soft")))  # one row
    for key in ("declared", "suffix", "domain", "host"):
        out = attach(out, sums([key]).select(key, vector(f"by_{key}")), [key])
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rest = lambda a: F.zip_with(a, "soft", lambda x, y: F.greatest(x - y, F.lit(0.0)))  # noqa: E731  without the page itself
    share = lambda a: F.transform(a, lambda x: (x + 0.5) / (size(a) + 0.5 * len(langs)))
    smooth = lambda a, prior: F.zip_with(a, prior, lambda x, p: (x + strength * p) / (size(a) + strength))
    out = out.withColumn("prior", share(F.col("all")))
    for key in ("domain", "host"):
        out = out.withColumn("prior", smooth(rest(F.col(f"by_{key}")), F.col("prior")))
    given = lambda key: F.zip_with(rest(F.col(f"by_{key}")), "all", lambda x, n: F.log((x + 0.5) / (n + 1.0)))
    logs = plus(plus(F.col("logs"), F.transform("prior", lambda p: F.log(p))), plus(given("declared"), given("suffix")))
    names = F.array(*map(F.lit, langs))
    first = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    out = out.withColumn("p", _softmax(logs))
    return out.select(*keep, first(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), first(F.col("soft")).alias("text_lang"))
