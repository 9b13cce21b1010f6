"""Sharding by histogram sort (native: DataFrame operations only).

Every row has a 63-bit sort key: 32 bits from the text, 31 from the document id,
so equal texts stand next to each other. For shard boundary i the wanted position
is i/n of all bytes. Each round counts exact bytes between candidate key
boundaries (one map-side combined aggregate) and keeps, for each splitter, only
the interval that holds its position; the next round's probes divide that
interval. A splitter is met once its interval is one text of at most
``tolerance`` of a shard, or one key. Rows then move once, to ranges of the key
order, of which shards are runs; slots count from the ranges' offsets, so a shard
of any size is numbered by many tasks.

Law ``bytes``: a row's shard is the one its byte midpoint falls in (a text's
midpoint where the whole group of equal texts is within the tolerance, so small
groups stay together; larger groups are split between their documents).

Null or empty text: size 16, crc32 0. Very long texts count whole; one that is
larger than a shard is a shard of its own. Null doc_id: sorted as the empty string.
Ties and repeated rows: rows with one key go to one shard, slots follow (key,
doc_id, size). An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered_by
from .common import hex_bits, settle

SHIFTS = (51, 39, 31, 19, 7, 0)
TEXT_SHIFT = 31
OVERHEAD = 16


def keyed(docs: DataFrame) -> DataFrame:
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.shiftleft(hex_bits(F.md5(text), 8), TEXT_SHIFT) + F.shiftright(hex_bits(F.md5(name), 8), 1)).alias("key"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Keys at which shards 1, 2, ... begin. Only histograms of a bounded size reach the driver."""
    found: dict[int, int] = {}
    total, open_ = None, {}
    for level, shift in enumerate(SHIFTS):
        scope = rows
        if level:
            if not open_:
                break
            scope = rows.where(F.shiftright("key", SHIFTS[level - 1]).isin(sorted({b for b, _ in open_.values()})))
        bins = [
            tuple(r)
            for r in scope.groupBy(F.shiftright("key", shift).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        ]
        bins.sort()
        if not level:
            total = sum(b[1] for b in bins)
            if not total:
                return []
            open_ = dict.fromkeys(range(1, shards), (None, 0))
        inside: dict[int | None, list] = {}
        for b in bins:
            inside.setdefault(b[0] >> (SHIFTS[level - 1] - shift) if level else None, []).append(b)
        starts = {}
        for parent, own in inside.items():
            sums = [0]
            for b in own:
                sums.append(sums[-1] + b[1])
            starts[parent] = sums
        again = {}
        for i, (parent, start) in open_.items():
            sums = starts[parent]
            place = bisect_right([(start + s) * shards for s in sums], i * total) - 1
            place = min(place, len(inside[parent]) - 1)
            name, size, low, high = inside[parent][place]
            begin = start + sums[place]
            one_text = low >> TEXT_SHIFT == high >> TEXT_SHIFT
            if low == high or one_text and size * shards <= tolerance * total:
                right = (2 * begin + size) * shards >= 2 * i * total
                found[i] = low if right else high + 1
            else:
                again[i] = (name, begin)
        open_ = again
    return [found[i] for i in sorted(found)]


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, key of every row."""
    rows = settle(keyed(docs))
    at = splitters(rows, shards, tolerance)
    number = F.size(F.filter(F.array(*map(F.lit, at)), lambda s: s <= F.col("key"))) if at else F.lit(0)
    placed = numbered_by(rows, "place", "key", "doc_id", "size").withColumn("shard", number.cast("int"))
    first = placed.groupBy(F.col("shard").alias("own")).agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("own")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "key",
    )
