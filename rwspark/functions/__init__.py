"""Column functions: text, chunk arrays, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special tokens, their ids, latencies, language names and instructions of the data format.
END_OF_READ, END_OF_WRITE = "<|end-of-read|>", "<|end-of-write|>"
LATENCY_TOKENS = {"low": "<|low-latency|>", "medium": "<|medium-latency|>", "high": "<|high-latency|>"}
SPECIAL_IDS = {"bos": 2, "eor": 262144, "eow": 262145, "low": 262146, "medium": 262147, "high": 262148}
LANGUAGES = {"ar": "Arabic", "cs": "Czech", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "vi": "Vietnamese", "zh": "Chinese"}
CJK = ("zh", "ja", "ko", "th", "km", "chinese", "japanese", "korean", "thai", "khmer")
LADDER = ("low", "low-medium", "medium", "medium-high", "high")
INSTRUCTION = "Translate the following text from %s into %s with %s latency."
CHAT_PROMPT = "Translate the following %s text to %s.\n\n%s: %s\n\n%s:"


def squeezed(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_cjk(lang: Column) -> Column:
    return F.lower(lang).isin(*CJK)


def joint(lang: Column) -> Column:
    """What stands between the words of a language."""
    return F.when(is_cjk(lang), "").otherwise(" ")


def word_count(text: Column, lang: Column) -> Column:
    """Words, or characters that are no white space where a language has no spaces."""
    return F.when(is_cjk(lang), F.length(F.regexp_replace(text, r"\s", ""))).otherwise(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))).cast("long")


def language_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def language_code(name: Column) -> Column:
    """Code of a name or code, null for others."""
    codes = F.create_map(*(F.lit(x) for code, word in LANGUAGES.items() for x in (word.lower(), code, code, code)))
    return F.try_element_at(codes, F.lower(name))


def by_latency(latency: Column, values: dict[str, object]) -> Column:
    """The latency's value; another latency is an error."""
    out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
    for key, value in values.items():
        out = out.when(latency == key, F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown latency "), F.coalesce(latency, F.lit("null")))))


def paired(source: Column, target: Column, out: Column) -> Column:
    """``out``, or an error where the sides have different numbers of chunks."""
    odd = F.raise_error(F.concat(F.lit("chunk counts differ: "), F.size(source).cast("string"), F.lit(" and "), F.size(target).cast("string")))
    return F.when(F.size(source) == F.size(target), out).otherwise(odd)


def interleaved(latency: Column, source: Column, target: Column) -> Column:
    """Latency token and chunks with end marks, all joined by spaces."""
    parts = F.zip_with(source, target, lambda s, t: F.concat_ws(" ", s, F.lit(END_OF_READ), t, F.lit(END_OF_WRITE)))
    return paired(source, target, F.concat_ws(" ", by_latency(latency, LATENCY_TOKENS), F.array_join(parts, " ")))


def marked(source: Column, target: Column, before_source: Column, before_target: Column) -> Column:
    """Chunks, stripped and with a separator before each, with end marks."""
    parts = F.zip_with(source, target, lambda s, t: F.concat(before_source, F.trim(s), F.lit(END_OF_READ), before_target, F.trim(t), F.lit(END_OF_WRITE)))
    return F.array_join(parts, "")


def interleaved_fixed(latency: Column, source: Column, target: Column) -> Column:
    """As interleaved, but a space stands before each chunk only, so that words keep their tokens."""
    return paired(source, target, F.concat(by_latency(latency, LATENCY_TOKENS), marked(source, target, F.lit(" "), F.lit(" "))))


def assistant_body(source: Column, target: Column, src_lang: Column, tgt_lang: Column) -> Column:
    """Chunks with end marks; a space before each chunk, none for languages without spaces."""
    gap = lambda lang: F.when(is_cjk(lang), "").otherwise(" ")
    return marked(source, target, gap(src_lang), gap(tgt_lang))


def user_instruction(latency: Column, src_lang: Column, tgt_lang: Column) -> Column:
    known = F.when(latency.isin(*LADDER), latency).otherwise(F.raise_error(F.concat(F.lit("unknown latency "), F.coalesce(latency, F.lit("null")))))
    return F.format_string(INSTRUCTION, language_name(src_lang), language_name(tgt_lang), known)


def chat(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """A fixed chat template; a system text is folded into the user's turn."""
    said = user if system is None else F.concat(system, F.lit("\n\n"), user)
    return F.concat(F.lit("<start_of_turn>user\n"), said, F.lit("<end_of_turn>\n<start_of_turn>model\n"), assistant, F.lit("<end_of_turn>\n"))


def annotator_prompt(source: Column, src_lang: Column, tgt_lang: Column, mode: str = "chat") -> Column:
    """What a model reads before the target: the source alone (raw), or an instruction with the names of the languages (chat)."""
    if mode == "raw":
        return F.concat(source, F.lit("\n"))
    if mode != "chat":
        raise ValueError(f"unknown prompt mode {mode}; there are chat, raw")
    return F.format_string(CHAT_PROMPT, src_lang, tgt_lang, src_lang, source, tgt_lang)


def latency_for(chunks: Column) -> Column:
    return F.when(chunks <= 3, "high").when(chunks <= 6, "medium").otherwise("low")


def merged_small(sizes: Column, least: int) -> Column:
    """Chunk sizes after merging forward: a chunk is closed once it has ``least`` words; what is left joins the chunk before."""
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(sizes, start, lambda s, x: F.when(
        s["held"] + x >= least, F.struct(F.lit(0).alias("held"), F.concat(s["out"], F.array(s["held"] + x)).alias("out"))
    ).otherwise(F.struct((s["held"] + x).alias("held"), s["out"].alias("out"))))
    tail = lambda s: F.when(s["held"] == 0, s["out"]).when(F.size(s["out"]) == 0, F.array(s["held"])).otherwise(F.transform(s["out"], lambda x, i: F.when(i == F.size(s["out"]) - 1, x + s["held"]).otherwise(x)))
    return tail(fold)


def merged_to(sizes: Column, n: Column) -> Column:
    """Chunk sizes merged to about n chunks: cuts at round(g * k / n), halves to even; empty groups are left out. Nothing is merged for n of 0 or less, or as many as there are."""
    cut = lambda g: F.bround(g * F.size(sizes).cast("double") / n).cast("int")
    total = lambda g: F.aggregate(F.slice(sizes, cut(g) + 1, cut(g + 1) - cut(g)), F.lit(0), lambda s, x: s + x)
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.when(cut(g + 1) > cut(g), total(g)))
    return F.when((n <= 0) | (n >= F.size(sizes)), sizes).otherwise(F.array_compact(groups))


def small_groups(counts: Column, least: int | Column) -> Column:
    """How many chunks make one, by their counts of words: a chunk under ``least`` joins the next, the last one that before."""
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        full = F.struct(F.lit(0).alias("held"), F.lit(0).alias("n"), F.concat(s["out"], F.array(s["n"] + 1)).alias("out"))
        return F.when(s["held"] + x >= least, full).otherwise(F.struct((s["held"] + x).alias("held"), (s["n"] + 1).alias("n"), s["out"].alias("out")))

    def finish(s):
        last = F.size(s["out"]) - 1
        return F.when(s["n"] == 0, s["out"]).when(last < 0, F.array(s["n"])).otherwise(F.transform(s["out"], lambda x, i: F.when(i == last, x + s["n"]).otherwise(x)))

    return F.aggregate(F.transform(counts, lambda x: x.cast("int")), start, step, finish)


def groups_to(chunks: Column, n: Column) -> Column:
    """How many chunks make one, where about n are to be left."""
    return merged_to(F.array_repeat(F.lit(1), F.size(chunks)), n)


def _spans(groups: Column) -> Column:
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at: int, n: int>>").alias("out"))
    return F.aggregate(groups, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), n.alias("n")))).alias("out")), lambda s: s["out"])


def joined(chunks: Column, groups: Column, lang: Column) -> Column:
    """Texts of merged chunks, stripped, with a space between them unless the language has none."""
    sep = F.when(is_cjk(lang), "").otherwise(" ")
    return F.transform(_spans(groups), lambda g: F.trim(F.call_function("array_join", F.transform(F.slice(chunks, g["at"], g["n"]), lambda x: F.trim(x)), sep)))


def gathered(ids: Column, groups: Column) -> Column:
    """Ids of merged chunks, which are arrays, in the same groups as their texts."""
    return F.transform(_spans(groups), lambda g: F.flatten(F.slice(ids, g["at"], g["n"])))


def least_words(lang: Column) -> Column:
    """Below how many words, or characters where a language has no spaces, a source chunk is too small."""
    return F.when(is_cjk(lang), 4).otherwise(2)


def word_id(word: Column) -> Column:
    """A word's id in a hashed vocabulary: the default, model-free tokenizer."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % 50000 + 10).cast("int")


def spliced(latency: Column, source_ids: Column, target_ids: Column) -> Column:
    """BOS, latency, then for each chunk source ids, end of read, target ids, end of write. Both are arrays of arrays."""
    parts = F.zip_with(source_ids, target_ids, lambda s, t: F.concat(s, F.array(F.lit(SPECIAL_IDS["eor"])), t, F.array(F.lit(SPECIAL_IDS["eow"]))))
    return F.concat(F.array(F.lit(SPECIAL_IDS["bos"]), by_latency(latency, {k: SPECIAL_IDS[k] for k in LATENCY_TOKENS})), F.flatten(parts))


def labels(ids: Column, prompt: Column) -> Column:
    """Ids with the first ``prompt`` masked by -100."""
    p = F.least(prompt, F.size(ids))
    return F.concat(F.array_repeat(F.lit(-100), p), F.slice(ids, p + 1, F.greatest(F.size(ids) - p, F.lit(0))))


def pieces(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character that is no white space: a model-free tokenizer of sub-words."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0))


def joined_lengths(chunks: Column, tokenize=pieces) -> Column:
    """How many tokens the first chunk has, the first two, and so on, each prefix joined by spaces before it is cut into tokens."""
    upto = lambda k: F.size(tokenize(F.array_join(F.slice(chunks, 1, k), " ")))
    return F.when(F.size(chunks) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(chunks)), upto))


def commits_of_lengths(source: Column, target: Column) -> Column:
    """The commit of each target token, from joined_lengths of both sides: that of its chunk, and none before an earlier one."""
    before = lambda k: F.coalesce(F.get(target, k - 1), F.lit(0))
    top = lambda k: F.array_max(F.slice(source, 1, k + 1))
    return paired(source, target, F.flatten(F.transform(target, lambda t, k: F.array_repeat(top(k), F.greatest(t - before(k), F.lit(0))))))


def padded(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def find_subsequence(ids: Column, needle: Column) -> Column:
    """First position (from 0) of needle in ids, -1 if there is none."""
    last = F.size(ids) - F.size(needle)
    return F.when(last < 0, -1).otherwise(F.coalesce(F.get(F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(ids, i + 1, F.size(needle)) == needle), F.lit(0)), F.lit(-1)))


def first_difference(a: Column, b: Column) -> Column:
    """Position (from 0) at which two id sequences differ, -1 if they are equal."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True) - 1).cast("int")


def char_spans(text: Column, chunks: Column) -> Column:
    """start and stop of each chunk, found one after another; null where one is missing or empty."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("good"), F.array().cast("array<struct<start: int, stop: int>>").alias("out"))

    def step(s, chunk):
        at = F.call_function("locate", chunk, text, s["at"] + 1)
        good = s["good"] & (at > 0) & (F.length(chunk) > 0)
        stop = at - 1 + F.length(chunk)
        return F.struct(F.when(good, stop).otherwise(s["at"]).alias("at"), good.alias("good"), F.concat(s["out"], F.array(F.struct((at - 1).alias("start"), stop.alias("stop")))).alias("out"))

    return F.aggregate(chunks, start, step, lambda s: F.when(s["good"], s["out"]))


# Distributions: arrays of equal length. Clamped from below, not scaled again.

EPS = 1e-12


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also within the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(xs: Column) -> Column:
    shared = lambda raised: bound(total(raised), lambda all: F.transform(raised, lambda x: x / all))
    return bound(F.array_max(xs), lambda top: bound(F.transform(xs, lambda x: F.exp(x - top)), shared))


def clamped(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.greatest(x, F.lit(EPS)))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(clamped(p), clamped(q), lambda x, y: x * F.log(x / y)))


def js(p: Column, q: Column) -> Column:
    a, b = clamped(p), clamped(q)
    side = lambda x, m: x * F.log(x / m)
    return total(F.zip_with(a, b, lambda x, y: 0.5 * (side(x, (x + y) / 2) + side(y, (x + y) / 2))))


def entropy(p: Column) -> Column:
    return -total(F.transform(clamped(p), lambda x: x * F.log(x)))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def cosine_cost(x: Column, y: Column) -> Column:
    """One less the cosine, at least 0."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(EPS))
    return F.greatest(1.0 - dot(x, y) / (norm(x) * norm(y)), F.lit(0.0))


def cosine(x: Column, y: Column) -> Column:
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(EPS))
    return dot(x, y) / (norm(x) * norm(y))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Of a position's logits, for the id that comes there; null for an id beyond them."""
    return bound(F.array_max(logits), lambda top: F.log(total(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.get(logits, label))


def gaussian(a: Column, b: Column) -> Column:
    """A normal number from two in [0, 1), multiples of 2^-32."""
    return F.sqrt(-2 * F.log(a + F.lit(2.0**-33))) * F.cos(2 * math.pi * b)


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def top_k(p: Column, k: int) -> Column:
    """Positions (from 0) of the k largest values; ties go to the lower position."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.slice(F.array_sort(pairs), 1, k)["i"]


def rank_of(score: Column, others: Column) -> Column:
    """Place of a score among others, from 1: how many are larger, and one."""
    return F.size(F.filter(others, lambda x: x > score)) + 1


#: Divergences by name: builders of columns from two distributions.
CRITERIA = {"js": js, "kl": kl}


def criterion(name: str):
    if name not in CRITERIA:
        raise ValueError(f"unknown criterion {name}; there are {', '.join(sorted(CRITERIA))}")
    return CRITERIA[name]
