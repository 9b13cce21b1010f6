"""What the corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import checkpoint_folder, staged

#: Fixed value: a word is a run of characters that are no ASCII white space.
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"
WORD = re.compile(WORD_CLASS)
#: Bytes of an Arrow batch, unless the session sets its own: bounds what a worker holds of long texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session has set a limit itself."""
    if not spark._jsparkSession.conf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder and read them from there."""
    return staged(df)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of any of Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) that connect what all of them connect."""
    up = list(range(n))
    out = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left = n
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((a, b))
            left -= 1
            if left == 1:
                break
    return out


def hex_bits(digest, digits: int):
    """The first hexadecimal digits of a digest column as a long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


#: Rounds by the order of the nodes themselves.
PLAIN_ROUNDS = 3


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b of one orderable type).

    Each round maps every node to the least of itself and its neighbours and
    contracts the graph by that map, until no edge is left; then the maps are
    joined in turn. A star is done in one round. From ``PLAIN_ROUNDS`` on, least is
    by a hash of the node and the round, so chains in order shrink by a factor each
    round too. Minima are combined map-side. A hub's edges are narrow rows that
    meet the map in a plain join of two written tables, which adaptive execution
    splits, so a hub with very many edges is not one task.

    Returns node, root (the least node of its component) for every node that has
    an edge to another node.
    """
    e = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    maps: list[DataFrame] = []
    for k in range(rounds):
        if e.isEmpty():
            break
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("node"), F.col("e.b").alias("m"))
        if k < PLAIN_ROUNDS:
            up = both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("root"))
        else:
            order = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))
            up = both.groupBy("node").agg(F.min(order("m")).alias("m")).select("node", F.least(order("node"), F.col("m"))["x"].alias("root"))
        up = settle(up)
        maps.append(up)
        for end in ("a", "b"):
            e = e.join(up.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end).drop(end)
        e = settle(e.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    plain = len(maps) <= PLAIN_ROUNDS
    found = maps.pop()
    while maps:
        top = found.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        found = settle(maps.pop().join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root")))
    if plain:
        return found
    least = settle(found.groupBy("root").agg(F.min("node").alias("_least")))
    return found.join(least, "root").select("node", F.col("_least").alias("root"))
