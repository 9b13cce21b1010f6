"""Quality rules: divergence of character and word distributions from language references.

Base rules count words, symbols, repeated lines and repeated 8-word windows of
the whole text and fail very short or very repetitive documents. Documents that
pass are compared with references of each language: histograms of character
classes and of the language's common words, learned from the corpus itself.

A language's common words are the ``COMMON`` words that stand in most of its
documents of ``LEAST_WORDS`` words or more (bare of punctuation, lower case, up to
``LONGEST`` characters; of equals the first by code point). Its reference is the
mean histogram of its documents that pass the base rules (every document has the
same weight); a language needs ``MIN_DOCS`` of them. A document is kept if for some
language both Jensen-Shannon distances are within their limits. A histogram of n
counts is away from its own source by a squared distance of about
(bins - 1) / (8 ln 2 n), so squared limits widen by that; texts under the minimum
lengths are not judged by the histogram concerned. A document that is
labelled with a language without a reference is not judged by references, nor is
any document of a corpus without labels.

The reach of the word rule: where 30% of a language's words are common ones, a text
without any is 0.4 away from the reference, which the rule finds from 50 words on.

Counts of words and the references are integer sums, so they do not depend on the
order of rows. What the driver gets is bounded: languages (``MOST_LANGUAGES`` at
most, else an error) x (classes + common words).

Null text: no words, base_failed. Empty text: the same. Null doc_id: returned as it
is. Null lang: compared with every reference, part of none. Very long texts are
counted whole. Ties: a distance at the limit is within. Repeated rows count each
and get equal results; an empty table gives no rows. Extra columns are ignored by
``judge``, whatever their names, and kept by ``good``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, bounded_batches, in_batches, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
EDGE = ".,;:!?'’\"()"
COMMON, LONGEST, MIN_DOCS = 32, 40, 20
MOST_LANGUAGES = 4096
#: Words that a task counts before it hands its counts on.
COUNTED = 200_000
CLASSES = 8
SHARE = 1_000_000
MIN_CHARS, MIN_WORDS = 100, 40
CHAR_LIMIT, WORD_LIMIT = 0.29, 0.22
#: Squared distance that n draws from a histogram of so many bins are away from it, times n.
CHAR_NOISE, WORD_NOISE = ((bins - 1) / (8 * math.log(2)) for bins in (CLASSES, COMMON + 1))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: lower, upper, other letter, digit, white space, end mark, other printable, rest."""
    import unicodedata

    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3}
    out = np.full(0x110000, 7, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        out[c] = kinds.get(k, 2 if k[0] in "LM" else 3 if k[0] == "N" else 4 if k[0] == "Z" else 6 if k[0] in "PS" else 7)
    out[[9, 10, 11, 12, 13]] = 4
    out[[ord(c) for c in ".,;:!?'’\"()-"]] = 5
    return out


#: A word without punctuation at its ends; words of punctuation alone have none.
BARE = re.compile(rf"[^\x20\x09-\x0D{re.escape(EDGE)}]+(?:[{re.escape(EDGE)}]+[^\x20\x09-\x0D{re.escape(EDGE)}]+)*")


def bare_words(text: str) -> list[str]:
    """The words in lower case, bare of punctuation."""
    return BARE.findall(text.lower())


def repeat_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
        total ^= total >> np.uint64(31)
    order = np.argsort(total)
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def base(text: str | None) -> tuple[list[str], tuple[int, int, int, int, int]]:
    """The words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif WORD.search(line):
            seen.add(line)
    return words, (len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dups, repeat_words(words))


def class_counts(text: str) -> np.ndarray:
    """Counts of the character classes."""
    chars = np.zeros(CLASSES, dtype=np.int64)
    for at in range(0, len(text), 1 << 20):
        code = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le"), dtype=np.uint32)
        chars += np.bincount(classes()[code], minlength=CLASSES)
    return chars


def word_counts(text: str, place: dict[str, int]) -> dict[int, int]:
    """How often each common word occurs, by its place."""
    return {place[w]: n for w, n in Counter(filter(place.__contains__, bare_words(text))).items()}


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits (the distance squared) of each row of ``p`` and the counts ``q``."""
    p, q = p / p.sum(axis=-1, keepdims=True), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.maximum(0.0, parts.sum(axis=-1) / 2)


class References:
    """The common words' places, and for each language the places of its own words and its two mean histograms."""

    def __init__(self, words: dict[str, list[str]], sums: dict[str, tuple[int, np.ndarray, dict[int, int]]]):
        """``words``: by language; ``sums``: by language the documents, and the sums of both kinds of shares."""
        self.place = places(words)
        self.known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for lang, (n, chars, common) in sorted(sums.items()):
            if n >= MIN_DOCS:
                own = np.array([self.place[w] for w in words.get(lang, [])], dtype=np.int64)
                mine = np.array([common.get(int(k), 0) for k in own], dtype=np.float64)
                self.known[lang] = own, chars.astype(np.float64), np.append(mine, common.get(-1, 0) - mine.sum())

    def near(self, langs: list[str | None], chars: np.ndarray, n_words: np.ndarray, common: list[dict[int, int]]) -> np.ndarray:
        """Whether each of several documents is near some reference, or is not to be judged."""
        n = len(langs)
        ok = np.array([lang is not None and lang not in self.known for lang in langs], dtype=bool) if self.known else np.ones(n, dtype=bool)
        counts = np.zeros((n, len(self.place)), dtype=np.float64)
        for i, found in enumerate(common):
            counts[i, list(found)] = list(found.values())
        n_chars = chars.sum(axis=1)
        for own, r_chars, r_words in self.known.values():
            mine = counts[:, own]
            mine = np.column_stack([mine, n_words - mine.sum(axis=1)])
            by_chars = (n_chars < MIN_CHARS) | (divergence(chars, r_chars) <= CHAR_LIMIT**2 + CHAR_NOISE / n_chars)
            by_words = (n_words < MIN_WORDS) | (divergence(mine, r_words) <= WORD_LIMIT**2 + WORD_NOISE / n_words)
            ok |= by_chars & by_words
        return ok


def places(words: dict[str, list[str]]) -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for own in words.values() for w in own}))}


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """By language the words that stand in most of its documents. Counts are combined task by task, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, value in zip(b.column(0), b.column(1), strict=True):
                text = value.as_py()
                words = bare_words(text)
                if len(words) >= LEAST_WORDS or len(WORD.findall(text)) >= LEAST_WORDS:
                    counts.setdefault(lang.as_py(), Counter()).update(set(words))
            if sum(map(len, counts.values())) > COUNTED:
                yield packed(counts)
                counts = {}
        yield packed(counts)

    def packed(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items() if len(w) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    rows = in_batches(docs.select("lang", "text").where("lang is not null and text is not null"), run, "lang string, word string, n long")
    rows = rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
    found: dict[str, list[str]] = {}
    for r in first.select("lang", "word").limit(MOST_LANGUAGES * COMMON + 1).collect():
        found.setdefault(r["lang"], []).append(r["word"])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return found


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > 30 * n_words


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("common", T.MapType(T.IntegerType(), T.LongType()))])


def measured(docs: DataFrame, words: dict[str, list[str]], whole: bool = False) -> DataFrame:
    """doc_id (or ``whole`` rows as doc), lang, the base counts, base_failed and, unless it failed, both histograms: chars, and common (place -> count)."""
    place = places(words)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(MEASURES)
    def measure(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            text = value.as_py()
            counts = base(text)[1]
            bad = failed(counts[0], counts[4])
            rows.append((*counts, bad, None if bad else class_counts(text), None if bad else list(word_counts(text, place).items())))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64()), pa.map_(pa.int32(), pa.int64())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=MEASURES.names)

    kept = F.struct(*docs.columns).alias("doc") if whole else F.col("doc_id")
    return docs.select(kept, F.col("lang").cast("string").alias("lang"), measure("text").alias("_m")).select("doc" if whole else "doc_id", "lang", "_m.*")


def references(rows: DataFrame, words: dict[str, list[str]]) -> References:
    """The languages' references, from what ``measured`` gives. Shares are whole millionths, so sums are exact."""
    good = rows.where("lang is not null and not base_failed")
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    share = good.select("lang", "n_words", F.explode(F.map_concat("common", F.create_map(F.lit(-1), F.col("n_words")))).alias("k", "v"))
    share = share.select("lang", "k", F.expr(f"v * {SHARE} div n_words").alias("v"))
    chars = good.select("lang", total.alias("n"), F.posexplode("chars").alias("k", "v")).select("lang", (-2 - F.col("k")).alias("k"), F.expr(f"v * {SHARE} div n").alias("v"))
    sums: dict[str, tuple[int, np.ndarray, dict[int, int]]] = {}
    for r in share.unionByName(chars).groupBy("lang", "k").agg(F.sum("v").alias("v"), F.count("*").alias("n")).collect():
        n, own, common = sums.get(r["lang"], (0, np.zeros(CLASSES), {}))
        if r["k"] <= -2:
            own[-2 - r["k"]] = r["v"]
        else:
            common[r["k"]] = r["v"]
        sums[r["lang"]] = max(n, r["n"]), own, common
    return References(words, sums)


def judged(rows: DataFrame, refs: References, *names: str) -> DataFrame:
    """The columns ``names`` of what ``measured`` gives, and kept."""
    shared = rows.sparkSession.sparkContext.broadcast(refs)
    bounded_batches(rows.sparkSession)

    @F.arrow_udf("boolean")
    def near(lang: pa.Array, n_words: pa.Array, chars: pa.Array, common: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(lang), 1024):
            own = (x.slice(at, 1024).to_pylist() for x in (lang, n_words, chars, common))
            lang_, n, c, w = own
            left = [i for i, x in enumerate(c) if x is not None]
            kept = np.zeros(len(n), dtype=bool)
            if left:
                kept[left] = shared.value.near([lang_[i] for i in left], np.array([c[i] for i in left], dtype=np.float64), np.array([n[i] for i in left], dtype=np.float64), [dict(w[i]) for i in left])
            out.append(kept)
        return pa.array(np.concatenate(out) if out else [], pa.bool_())

    return rows.select(*names, near("lang", "n_words", "chars", "common").alias("_kept"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row. Their small histograms are written and read again."""
    words = common_words(docs)
    rows = settle(measured(docs, words))
    return judged(rows, references(rows, words), "doc_id", *COUNTS, "base_failed").withColumnRenamed("_kept", "kept")


def good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep. They are written with their histograms, so texts are measured once."""
    words = common_words(docs)
    rows = settle(measured(docs, words, whole=True))
    return judged(rows, references(rows, words), "doc").where("_kept").select("doc.*")
