"""Usage kept up to date from a folder that receives event files.

Each micro-batch adds its (directory, uid) sums to a partial-sums table; readers
add up what is there. A batch writes under its own number, so a batch that is run
again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tree import direct_usage, subtree_usage

EVENTS = "uid long, size long, path string"


def follow(spark: SparkSession, events: str, sums: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start adding new Parquet event files (uid, size, path) to the sums."""

    def add(batch: DataFrame, number: int) -> None:
        direct_usage(batch).write.mode("overwrite").parquet(f"{sums}/batch={number}")

    writer = spark.readStream.schema(EVENTS).parquet(events).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def direct_sums(spark: SparkSession, sums: str) -> DataFrame:
    """dir, uid, size, files over all batches so far."""
    return spark.read.parquet(sums).groupBy("dir", "uid").agg(F.sum("size").alias("size"), F.sum("files").alias("files"))


def compact(spark: SparkSession, sums: str, target: str) -> None:
    """Write the sums of all batches as one batch elsewhere, to replace many small ones."""
    direct_sums(spark, sums).write.mode("overwrite").parquet(f"{target}/batch=-1")


def subtree_sums(spark: SparkSession, sums: str) -> DataFrame:
    return subtree_usage(direct_sums(spark, sums))
