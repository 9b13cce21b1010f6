"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased as a whole, letters stay, everything else is a blank, as are
its two ends, and every run of 1 to 3 characters without two blanks in a row is
hashed to one of ``2 ** bits`` buckets. Training sums bucket counts per language
(partition by partition in numpy, then one aggregate); the matrix of
log-probabilities is broadcast. The texts of a batch are put one behind the other
and scored together: their n-grams are the entries of a sparse matrix of texts and
buckets, whose product with the matrix of log-probabilities is one gather of its
rows and one sum for each text.

Over n-grams the score of the best language nears 1 after a few words, in whatever
language or noise the text is. ``confident`` therefore also asks that the mean
log-probability of the text's n-grams is nearer to that of training text of its
language than to that of the nearest other language's (``least_fit``).

Bounds: at most about ``DOCS_A_LANGUAGE`` labelled documents of each language
train the model (picked by a hash of the doc_id); buckets shrink so that languages
x buckets stay within ``MOST_CELLS``, which bounds the broadcast to 32 MB; more
than ``MOST_LANGUAGES`` languages are an error. All languages have the same prior.

Null text, empty text or text without a letter: ``und`` with score 0. Documents
with a null doc_id or null lang never train and are not held out. Without any
training text, and for an empty table, there is nothing to learn: every document
is ``und``. Very long texts are counted whole, ``CHUNK`` characters at a time. Ties
between languages go to the first by code point. Repeated rows get equal results;
extra columns are ignored by ``identify``, whatever their names, and kept by
``confident``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_batches

DOCS_A_LANGUAGE = 6000
BITS = 15
MOST_CELLS = 1 << 22
MOST_LANGUAGES = 1 << 14
#: Characters that are taken at once, and numbers that are gathered at once.
CHUNK, GATHERED = 1 << 17, 1 << 21
SMOOTHING = 0.5
UNKNOWN = "und"
#: Standard deviations of the mean that a short text may fall below, and the n-grams that start at one character.
DEVIATIONS, GRAMS = 3, 3
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(code: np.ndarray, own: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of each length: where they start, among the first ``own`` characters, in order, and their buckets."""
    shift = np.uint64(64 - bits)
    blank = code == 32
    gram, ok = code + np.uint64(1), ~blank
    first = np.flatnonzero(ok[:own])
    yield first, (gram[first] * MIX >> shift).astype(np.int64)
    ok = np.ones(len(code), dtype=bool)
    for n in (2, 3):
        gram = gram[:-1] * MIX + code[n - 1 :] + np.uint64(1)
        ok = ok[:-1] & ~(blank[n - 2 : -1] & blank[n - 1 :])
        first = np.flatnonzero(ok[:own])
        yield first, ((gram[first] ^ gram[first] >> np.uint64(29)) * MIX >> shift).astype(np.int64)


def entries(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of several texts: which text each belongs to (in order), and its bucket. Some at a time."""
    table = letters()

    def step(part: list[str], places: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = " " + "  ".join(part) + " "
        starts = np.cumsum([0] + [len(t) + 2 for t in part[:-1]])
        number = np.array(places)
        for at in range(0, len(whole), CHUNK):
            code = np.frombuffer(whole[at : at + CHUNK + 2].encode("utf-32-le"), dtype=np.uint32)
            code = np.where(table[code], code, 32).astype(np.uint64)
            for first, bucket in grams(code, CHUNK, bits):
                yield number[np.searchsorted(starts, first + at, side="right") - 1], bucket

    part, places, size = [], [], 0
    for i, text in enumerate(texts):
        if text:
            part.append(text.lower())
            places.append(i)
            size += len(part[-1]) + 2
            if size >= CHUNK:
                yield from step(part, places)
                part, places, size = [], [], 0
    if part:
        yield from step(part, places)


def bucket_counts(text: str | None, bits: int) -> np.ndarray | None:
    """Counts of the buckets of one whole text; None if it has no letter."""
    total = np.zeros(1 << bits, dtype=np.int64)
    for _, bucket in entries([text], bits):
        total += np.bincount(bucket, minlength=1 << bits)
    return total if total.any() else None


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray, bits: int):
        self.languages, self.log_p, self.bits = languages, log_p, bits
        self.fit: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-probabilities (texts x languages) and numbers of n-grams."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        if not self.languages:
            return out, n
        width = max(1, GATHERED // len(self.languages))
        for where, bucket in entries(texts, self.bits):
            for at in range(0, len(where), width):
                own = where[at : at + width]
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[begin]] += np.add.reduceat(self.log_p[bucket[at : at + width]], begin, axis=0)
                n[own[begin]] += np.diff(np.append(begin, len(own)))
        return out, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of several texts."""
        sums, n = self.scores(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = sums.argmax(axis=1)
        score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if m else UNKNOWN for k, m in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)

    def sure(self, texts: list[str | None], score_least: float) -> np.ndarray:
        """Whether the score is high enough and the text fits the language as its own text does."""
        sums, n = self.scores(texts)
        if not self.languages:
            return np.zeros(len(texts), dtype=bool)
        best, top = sums.argmax(axis=1), sums.max(axis=1)
        score = 1 / np.exp(sums - top[:, None]).sum(axis=1)
        least, spread = self.least_fit()
        some = np.maximum(n, 1)
        return (n > 0) & (score >= score_least) & (top / some >= least[best] - DEVIATIONS * spread[best] * np.sqrt(GRAMS / some))

    def least_fit(self) -> tuple[np.ndarray, np.ndarray]:
        """Per language: the mean log-probability halfway between its own text and the nearest other language's, and the deviation of one n-gram's.

        With one language there is no other to compare with and every text fits.
        """
        if self.fit is None:
            p = np.exp(self.log_p)
            own, near = np.einsum("ij,ij->j", p, self.log_p), np.full(p.shape[1], -np.inf)
            for k in range(p.shape[1]):
                means = p[:, k] @ self.log_p
                means[k] = -np.inf
                near = np.maximum(near, means)
            self.fit = (own + near) / 2, np.sqrt(np.maximum(0, np.einsum("ij,ij->j", p, self.log_p**2) - own**2))
        return self.fit


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Model:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    use = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (part != 1))
    sizes = {r["lang"]: r["count"] for r in use.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), BITS)
    bits = BITS
    while len(languages) << bits > MOST_CELLS:
        bits -= 1
    most = 1 << 30
    if any(n > DOCS_A_LANGUAGE for n in sizes.values()):
        below = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(most, most * DOCS_A_LANGUAGE // n)))])
        use = use.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(most)) < F.element_at(below, F.col("lang")))

    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            own = np.array([place[k] for k in b.column(0).to_pylist()], dtype=np.int64)
            for where, bucket in entries([t.as_py() for t in b.column(1)], bits):
                lang = own[where]
                for k in np.unique(lang).tolist():
                    found = np.bincount(bucket[lang == k], minlength=1 << bits)
                    sums[k] = sums[k] + found if k in sums else found
                if len(sums) > 256:
                    yield from map(packed, sums.items())
                    sums = {}
        yield from map(packed, sums.items())

    def packed(item: tuple[int, np.ndarray]) -> pa.RecordBatch:
        full = np.flatnonzero(item[1])
        return pa.RecordBatch.from_arrays([pa.array(full * len(languages) + item[0]), pa.array(item[1][full])], names=["cell", "n"])

    cells = in_batches(use.select(F.col("lang").cast("string"), "text"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) << bits, SMOOTHING)
    counts[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    counts = counts.reshape(1 << bits, len(languages))
    return Model(languages, np.log(counts / counts.sum(axis=0)), bits)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict([t.as_py() for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return in_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def confident(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least`` and whose text fits it."""
    model = train(docs)
    if model.languages:
        model.least_fit()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def sure(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.sure([t.as_py() for t in texts], least))

    return docs.where(sure("text"))
