"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. A table hashes a vector to
``k`` quantised random projections floor((a.x + b) / w); vectors that share all k
of any table are compared. ``k`` follows from the number of distinct vectors, so
that unrelated ones seldom meet, and the number of tables from k, so that a pair
at the limit meets with probability ``RECALL`` (closer pairs sooner). Both grow
with the number, k by its logarithm and the tables by about its sixth root: with a
fixed k the pairs that meet by chance would grow by its square. Projections are
integers in double precision, hence exact and the same in every task; they are
made ``PART`` tables at a time.

Equal vectors are collapsed first and count with their multiplicity. Only
buckets with two or more members receive vectors; a bucket of more than ``BLOCK``
members is divided into pairs of blocks. A block pair computes cosines as one
matrix product and returns, for each member, the links first found in this table
(a bucket's key names its table; linked vectors are hashed into earlier tables
until each pair is settled), and edges that keep its links connected - never its
pairs. A cosine within 1e-9 of the limit is computed once more for the pair alone,
dot product over the product of the norms; at the limit it links.

Vectors that are null, empty, all zero, or hold null or non-finite components
link with nothing (n_links 0, a component of their own), nor do vectors of
different lengths with each other. Null vec_id: the row is its class's member;
component_id is the smallest id that is not null. Repeated rows, of one vec_id too,
are other vectors and link with each other. Long vectors are hashed like others; a
block holds at most 2 x ``BLOCK`` of them. An empty table gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_batches, settle, spanning

LEAST = 0.95
WIDTH = 2.0
RECALL = 0.9999
BLOCK = 1024
SEED = 20
#: Tables that are computed at once; the bits of a key that name its table.
PART, TABLE_BITS = 8, 12


def same_bucket(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points at this distance in one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """Projections of a table and number of tables for n distinct vectors."""
    far, near = same_bucket(math.sqrt(2)), same_bucket(math.sqrt(2 - 2 * least))
    k = max(4, math.ceil(math.log(20 * max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


@lru_cache(maxsize=64)
def projections(size: int, k: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one part of the tables."""
    rng = np.random.default_rng([SEED, size, part])
    a = np.rint(rng.standard_normal((size, k * PART)) * 2**16)
    return a, np.rint(rng.random(k * PART) * WIDTH * 2**36)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def part_keys(x: np.ndarray, k: int, part: int) -> np.ndarray:
    """64-bit bucket keys of unit vectors in the tables of one part; the lowest bits are the table's number."""
    a, b = projections(x.shape[1], k, part)
    cell = np.floor((np.rint(x * 2**20) @ a + b) / (WIDTH * 2**36)).astype(np.int64).view(np.uint64).reshape(len(x), PART, k)
    table = np.arange(PART, dtype=np.uint64) + np.uint64(part * PART)
    total = np.broadcast_to(table + np.uint64(x.shape[1] << 32), (len(x), PART)).copy()
    for i in range(k):
        total = (total ^ cell[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return (total << np.uint64(TABLE_BITS) | table).view(np.int64)


def table_keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The keys in all tables."""
    return np.concatenate([part_keys(x, k, p) for p in range(-(-tables // PART))], axis=1)[:, :tables]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, node (digest; null if the vector links with nothing), vec (doubles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, raw = [], []
            for value in b.column(1):
                x = np.array([np.nan if v is None else v for v in value.as_py() or []], dtype=np.float64) + 0.0
                with np.errstate(over="ignore"):
                    ok = len(x) and np.isfinite(x).all() and 0 < (x * x).sum() < np.inf
                raw.append(x.tobytes() if ok else None)
                nodes.append(hashlib.sha256(raw[-1]).digest()[:16] if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary())], names=["id", "node", "vec"])

    return in_batches(vectors.select(key, vector), run, f"id {dict(vectors.dtypes)[key]}, node binary, vec binary")


def hashed(reps: DataFrame, k: int, tables: int) -> DataFrame:
    """key, node of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sizes = np.array([len(v.as_py()) for v in part["vec"]])
                for size in np.unique(sizes):
                    own = part.take(pa.array(np.flatnonzero(sizes == size)))
                    x = np.stack([np.frombuffer(v.as_py()) for v in own["vec"]])
                    keys = table_keys(unit(x), k, tables)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), own["node"].take(pa.array(np.repeat(np.arange(len(x)), tables)))], names=["key", "node"])

    return in_batches(reps.select("node", "vec"), run, "key long, node binary")


def linked(raw: np.ndarray, side: np.ndarray, key: int, alone: bool, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one block (alone) or across two blocks that link and meet first in this bucket."""
    x = unit(raw)
    cosine = x @ x.T
    near = cosine >= least - 1e-9
    near = np.triu(near, 1) if alone else near & (side[:, None] < side[None, :])
    i, j = np.nonzero(near)
    edge = np.flatnonzero(cosine[i, j] <= least + 1e-9)
    if len(edge):
        keep = np.ones(len(i), dtype=bool)
        for at in edge.tolist():
            a, b = raw[i[at]], raw[j[at]]
            keep[at] = np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))) >= least
        i, j = i[keep], j[keep]
    table = key & (1 << TABLE_BITS) - 1
    for part in range(-(-table // PART)):
        if not len(i):
            break
        own, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = part_keys(x[own], k, part)[:, : table - part * PART]
        first, second = place[: len(i)], place[len(i) :]
        met = np.zeros(len(i), dtype=bool)
        for t in range(keys.shape[1]):
            met |= keys[first, t] == keys[second, t]
        i, j = i[~met], j[~met]
    return i, j


def compared(rows: DataFrame, k: int, least: float) -> DataFrame:
    """node, other, n: links of each member (other null), and connecting edges (n null).

    ``rows`` (key, g1, g2, side, node, vec, n) are sorted by (key, g1, g2).
    """

    def one(own: list[tuple]) -> list[tuple]:
        key, g1, g2 = own[0][:3]
        i, j = linked(np.stack([np.frombuffer(r[5]) for r in own]), np.array([r[3] for r in own]), key, g1 == g2, k, least)
        if not len(i):
            return []
        n = np.array([r[6] for r in own])
        links = np.bincount(i, n[j], len(own)).astype(np.int64) + np.bincount(j, n[i], len(own)).astype(np.int64)
        out = [(own[m][4], None, int(links[m])) for m in np.flatnonzero(links)]
        return out + [(own[a][4], own[b][4], None) for a, b in spanning(len(own), i, j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["node", "other", "n"])

        own, out = [], []
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("key", "g1", "g2", "side", "node", "vec", "n")), strict=True):
                if own and own[0][:3] != row[:3]:
                    if len(own) > 1:
                        out += one(own)
                    own = []
                own.append(row)
            if len(out) > 4096:
                yield packed(out)
                out = []
        if len(own) > 1:
            out += one(own)
        yield packed(out)

    return in_batches(rows, run, "node binary, other binary, n long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``key``, n_links, component_id, kept of every row."""
    rows = settle(usable(vectors, key, vector))
    reps = settle(rows.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("low")))
    k, tables = parameters(reps.count(), least, recall)
    narrow = settle(hashed(reps, k, tables))
    shared = narrow.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = narrow.join(shared, "key")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.select("key", F.least("own", "with").alias("g1"), F.greatest("own", "with").alias("g2"), F.col("own").alias("side"), "node")
    dealt = met.join(reps.select("node", "vec", "n"), "node")
    many = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "g1", "g2", "side", "node", "vec", "n").repartition(many, "key", "g1", "g2").sortWithinPartitions("key", "g1", "g2")
    found = settle(compared(dealt, k, least))
    links = found.where("other is null").groupBy("node").agg(F.sum("n").alias("links"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    placed = settle(reps.select("node", "n", "low").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = settle(placed.groupBy("root").agg(F.min("low").alias("component_id")))
    placed = placed.join(ids, "root").join(links, "node", "left")
    placed = settle(placed.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"))
    out = rows.select("id", "node").join(placed, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
