"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

A text's weighted set is its five-word shingles with their counts (a text of one
to four words is one shingle). The c-th unit of a shingle's weight is a region of
its own; darts fall into a region at the times of a unit-rate Poisson process
that depends only on (shingle, c), so texts that share the unit share its darts.
Each dart belongs to a random coordinate of the signature; the earliest dart per
coordinate is kept. A text throws darts until an expected ``k ln k + 2k`` have
fallen, and twice as long if a coordinate is still empty. Two signatures agree
in a coordinate with the weighted Jaccard similarity as probability.

Texts are read once for their signatures, which are written (one row a document,
200 bytes). Bands of ``rows`` coordinates are joined. Equal texts count once.
Within a band bucket every member is first paired with the bucket's smallest
member only; pairs are checked exactly (weighted Jaccard over whole texts). The
pairs of a bucket's smallest member are split between tasks, and its text is sent
once to each. Buckets whose members are then not known to be connected are
compared in blocks: a task gets a block pair's texts, keeps their cells, counts
common ones by matrix products and returns edges that keep the links connected.
Blocks are bounded by the size of their texts. So no candidate link is lost, and
no group is expanded into its pairs. Chance: a pair of similarity 0.8 shares a
bucket with probability 1 - (1 - 0.8^5)^24 = 0.99993.

Null text, or text without a word: in no class but its own, never linked. Null
doc_id: the row is part of its text's class; a class whose ids are all null has
class_id null and keeps its rows. Repeated rows get one class; rows that repeat
the kept doc_id are kept with it. A pair at exactly the least similarity links.
Very long texts are read whole; a block holds one of them and little else. An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, in_batches, settle, spanning

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
CELLS_A_STEP = 150_000
#: A block's size, and what its texts count: one, and one more for each CELLS_A_UNIT words.
BLOCK = 512
CELLS_A_UNIT = 1024
#: Pairs of one bucket's smallest member that are checked in one group.
PAIRS = 2048
COLUMNS = 1 << 12
MOST_SEEN = 200_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """64-bit hash of a word. Forgets when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = found
        return found


WORD_HASHES = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text, repeated ones as often as they occur; empty without words."""
    words = WORD.findall(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(WORD_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total * GOLD + own[k : k + n])
    return total


def unit_cells(own: np.ndarray) -> np.ndarray:
    """One hash for each unit of weight: (shingle, 1), (shingle, 2), ..."""
    if not len(own):
        return own
    own = np.sort(own)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return mixed(own + mixed(rank.astype(np.uint64) + GOLD))


def signatures(cells: list[np.ndarray], k: int) -> np.ndarray:
    """k coordinates (64-bit dart names) of each of several texts with at least one cell."""
    out = np.zeros((len(cells), k), dtype=np.uint64)
    todo, most = np.arange(len(cells)), k * math.log(k) + 2 * k
    while len(todo):
        sizes = np.array([len(cells[i]) for i in todo])
        cell = np.concatenate([cells[i] for i in todo])
        doc = np.repeat(np.arange(len(todo)), sizes)
        limit = np.repeat(most / sizes, sizes)
        time = np.zeros(len(cell))
        names, coords, times, docs = [], [], [], []
        step = 0
        while len(cell):
            step += 1
            name = mixed(cell + np.uint64(step * int(GOLD) % 2**64))
            time = time - np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = time <= limit
            cell, doc, limit, time, name = cell[on], doc[on], limit[on], time[on], name[on]
            pick = mixed(name + GOLD)
            names.append(pick)
            coords.append(((pick >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
            times.append(time)
            docs.append(doc)
        place = np.concatenate(docs) * k + np.concatenate(coords)
        order = np.lexsort((np.concatenate(times), place))
        place = place[order]
        first = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, dtype=bool)
        sig = np.zeros(len(todo) * k, dtype=np.uint64)
        full = np.zeros(len(todo) * k, dtype=bool)
        sig[place[first]] = np.concatenate(names)[order][first]
        full[place[first]] = True
        done = full.reshape(-1, k).all(axis=1)
        out[todo[done]] = sig.reshape(-1, k)[done]
        todo, most = todo[~done], 2 * most
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64) * GOLD, (len(sig), bands)).copy()
    for r in range(rows):
        total = mixed(total + sig[:, r::rows][:, :bands] * GOLD)
    return total.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two texts, given their sorted cells: units in both over units in either."""
    low = len(np.intersect1d(a, b, assume_unique=True))
    return low / (len(a) + len(b) - low) if low else 0.0


def links(cells: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of similar enough texts. Common units are counted by matrix products, ``COLUMNS`` units at a time."""
    n = len(cells)
    sizes = np.array(list(map(len, cells)))
    unit, counts = np.unique(np.concatenate(cells), return_counts=True)
    unit = unit[counts > 1]
    both = np.zeros((n, n), dtype=np.float32)
    for at in range(0, len(unit), COLUMNS):
        part = unit[at : at + COLUMNS]
        m = np.zeros((n, len(part)), dtype=np.float32)
        for i, own in enumerate(cells):
            m[i, np.searchsorted(part, own[np.isin(own, part, assume_unique=True)])] = 1
        both += m @ m.T
    both = both.astype(np.float64)
    either = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu((both >= 1) & (both / np.maximum(either, 1) >= least), 1))


def text_node():
    """128 bits of the text's digest; null without a word."""
    has = F.coalesce(F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))
    return F.when(has, F.substring(F.unhex(F.sha2("text", 256)), 1, 16)).alias("node")


def own_id(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def cells_of(text: str | None) -> np.ndarray:
    return np.sort(unit_cells(shingles(text)))


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node, cells (units of the text), keys (of its bands) of every row. A text that the task has just had has null keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[bytes] = set()
        for b in batches:
            nodes, texts = b.column(1), b.column(2)
            sizes, keys = np.zeros(b.num_rows, dtype=np.int64), [None] * b.num_rows
            places, cells, size = [], [], 0
            for i in range(b.num_rows):
                node = nodes[i].as_py()
                if node is None or node in had:
                    continue
                if len(had) >= MOST_SEEN:
                    had.clear()
                had.add(node)
                own = unit_cells(shingles(texts[i].as_py()))
                sizes[i] = len(own)
                places.append(i)
                cells.append(own)
                size += len(own)
                if size >= CELLS_A_STEP:
                    fill(keys, places, cells)
                    places, cells, size = [], [], 0
            if cells:
                fill(keys, places, cells)
            yield pa.RecordBatch.from_arrays([b.column(0), nodes, pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "cells", "keys"])

    def fill(keys: list, places: list[int], cells: list[np.ndarray]) -> None:
        for i, own in zip(places, band_keys(signatures(cells, bands * rows), bands, rows), strict=True):
            keys[i] = own

    return in_batches(docs.select("doc_id", text_node(), "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, cells long, keys array<long>")


def checked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, by whole texts.

    The pairs of one ``a`` are split into groups of about ``PAIRS``; its text comes
    first in each group and is sent once to each.
    """
    many = settle(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")))
    first = many.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "text")
    rest = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    rest = rest.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "part", "b", "text")
    number = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(rest).repartition(number, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in batches:
            keep = []
            for i, (b, text) in enumerate(zip(batch["b"], batch["text"], strict=True)):
                own = cells_of(text.as_py())
                if not b.is_valid:
                    cells = own
                elif similarity(cells, own) >= least:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return in_batches(dealt, run, "a binary, b binary")


def across(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between the roots whose members are linked, of each bucket of ``rows`` (band_key, node, root, cells).

    A bucket is divided into blocks by the size of its texts; each pair of blocks
    that holds several roots is compared in one task by matrix products, and
    returns connecting edges only.
    """
    key = ["band_key", "g1", "g2"]
    sizes = settle(rows.groupBy("band_key").agg(F.ceil(F.sum(1 + F.floor(F.col("cells") / CELLS_A_UNIT)) / BLOCK).cast("int").alias("parts")))
    met = rows.join(sizes, "band_key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("band_key", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.select("band_key", F.least("own", "with").alias("g1"), F.greatest("own", "with").alias("g2"), "node", "root")
    several = met.groupBy(*key).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*key)
    met = met.join(several, key, "left_semi").join(texts.select("node", "text"), "node")
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select(*key, "node", "root", "text").repartition(many, *key).sortWithinPartitions(*key)

    def one(nodes: list[bytes], roots: list[bytes], cells: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        i, j = links(cells, least)
        place = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        own = np.array([place[r] for r in roots])
        apart = own[i] != own[j]
        joined = spanning(len(place), own[i[apart]], own[j[apart]])
        names = list(place)
        return [(names[x], names[y]) for x, y in joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

        last, own, out = None, ([], [], []), []
        for batch in batches:
            places = zip(*(batch[c].to_pylist() for c in key), strict=True)
            for at, node, root, text in zip(places, batch["node"], batch["root"], batch["text"], strict=True):
                if at != last:
                    out += one(*own) if len(own[0]) > 1 else []
                    last, own = at, ([], [], [])
                for column, value in zip(own, (node.as_py(), root.as_py(), cells_of(text.as_py())), strict=True):
                    column.append(value)
            if len(out) > 4096:
                yield packed(out)
                out = []
        yield packed(out + (one(*own) if len(own[0]) > 1 else []))

    return in_batches(dealt, run, "a binary, b binary")


def classes(docs: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """node, root, class_id of every distinct text that has a word: its component, and the smallest doc_id of that.

    ``rows``: what ``signed`` gives for ``docs``. Components that share a doc_id may
    have the same class_id; root tells them apart. Only the texts that share a
    bucket with another are kept for the comparisons.
    """
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("cells").alias("cells"), F.first("keys", ignorenulls=True).alias("keys"))
    nodes = settle(nodes)
    member = nodes.select(F.explode("keys").alias("band_key"), "node", "cells")
    # written first, so that the join is one of two plain tables, which adaptive execution splits
    low = settle(member.groupBy("band_key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"))
    member = settle(member.join(low, "band_key").select("band_key", "n", "a", F.col("node").alias("b"), "cells"))
    pairs = settle(member.where("a <> b").select("a", "b").distinct())
    involved = member.select(F.col("b").alias("node")).distinct().join(nodes.select("node", own_id("low").alias("id")), "node")
    texts = docs.select(text_node(), own_id("doc_id").alias("id"), "text").join(involved, ["node", "id"])
    texts = settle(texts.groupBy("node", "id").agg(F.first("text").alias("text")))
    found = settle(checked(pairs, texts, least))
    roots = settle(components(found))
    # members that are still apart from others of their bucket
    state = member.where("n > 2").join(roots.select(F.col("node").alias("b"), "root"), "b", "left")
    state = settle(state.select("band_key", F.col("b").alias("node"), F.coalesce("root", "b").alias("root"), "cells"))
    apart = state.groupBy("band_key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band_key")
    more = settle(across(settle(state.join(settle(apart), "band_key", "left_semi")), texts, least))
    placed = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    if not more.isEmpty():
        # the components that these edges join: the graph of the roots is enough
        top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        placed = placed.join(top, "root", "left").select("node", "low", F.coalesce("top", "root").alias("root"))
    placed = settle(placed)
    ids = settle(placed.groupBy("root").agg(F.min("low").alias("class_id")))
    return settle(placed.join(ids, "root").select("node", "root", "class_id"))


def near_duplicates(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, kept of every row."""
    own = settle(signed(docs, bands, rows))
    found = own.select("doc_id", "node").join(classes(docs, own, least), "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, class_id.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with one document of each class, the one with its smallest doc_id.

    Of rows of one class that share that doc_id the least one by its columns' text
    stays, so reruns agree. Rows of no class, or of one without a doc_id, all stay.
    """
    names = docs.columns
    own = settle(signed(docs, BANDS, ROWS))
    kept = classes(docs, own, least)
    rows = docs.select(F.struct(*names).alias("doc"), "doc_id", text_node())
    rows = rows.join(kept, "node", "left").where(F.col("node").isNull() | F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id")))
    if not own.groupBy("doc_id").count().where("count > 1").isEmpty():
        plain = F.col("node").isNull() | F.col("class_id").isNull()
        order = Window.partitionBy("root").orderBy(F.xxhash64("doc"), F.to_json("doc"))
        single = rows.where(~plain).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        rows = single.unionByName(rows.where(plain))
    return rows.select("doc.*")
