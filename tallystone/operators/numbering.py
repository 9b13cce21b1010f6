"""Dense numbers in a complete order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: How ``monotonically_increasing_id`` is made up: the partition above, the place in it below.
PLACE_BITS = 33


def numbered_by(rows: DataFrame, number: str, *order: str | Column) -> DataFrame:
    """``rows`` with ``number``, from 0, in the order of ``order``, which must be complete.

    Rows are dealt to ranges of the whole order key and sorted there, so a common
    prefix or a frequent value fills no range by itself. The sorted rows are
    written once: their place in a range counts from the range's offset, and the
    offsets come from the counts of the ranges, of which there are as many as
    shuffle partitions. Rows that are equal in ``order`` stand next to each other.
    """
    placed = staged(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)
    found = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return found.withColumn(number, (F.col("_offset") + within).cast("long")).drop("_place", "_part", "_offset")
