"""Mixing sources to target weights by hash order, prefix sums and exact cuts.

Every document gets a hash-random key. The source's target is a number of whole
passes over the source plus a rest: the rest goes to the first documents in key
order, and the document at the cut gives only the words that are left of the
budget. To find the cut, sources are divided into key ranges of about
``RANGE_ROWS`` documents (keys are uniform, so ranges are even however large a
source is); prefix sums of the ranges tell the range that holds a source's cut,
and prefix sums inside that range the document. Every row is then compared with
its source's cut, so rows are not moved at all.

The table of sources with their cuts is broadcast if it measures at most
``MOST_BROADCAST`` bytes, else joined like any other.

Null text: size 0, never taken. Null source: a source of its own, the last. Null
doc_id: comes before others of the same key. Repeated rows are equal in key
order; at the cut they share what is left of the budget evenly, rounded down, so
that reruns agree. Very long texts are sized whole, and give a part of their words
at the cut. A source without words has target 0. An empty table gives no rows.
Extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered_by
from .common import WORD_CLASS, hex_bits, settle

RANGE_ROWS = 4096
MOST_BROADCAST = 8 << 20
KEY_BITS = 60
RANGE_BITS = 20


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def random_key(doc_id, text, seed: str):
    name = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return hex_bits(F.md5(name), KEY_BITS // 4)


def targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """s_source, s_id, s_weight, s_size, s_rows, target of every source of ``rows`` (source, size).

    All words are shared by weight; what exceeds ``most`` times a source is shared
    anew among the others until no target is above. Only two sums a round reach
    the driver.
    """
    each = rows.groupBy(F.col("source").alias("s_source")).agg(F.sum("size").alias("s_size"), F.count("*").alias("s_rows"))
    each = numbered_by(each, "s_id", F.col("s_source").asc_nulls_last())
    each = settle(each.withColumn("s_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("s_id") % len(weights) + 1).cast("int")).cast("long")))
    total, weight = each.agg(F.sum("s_size"), F.sum("s_weight")).first()
    if not weight:
        return each.withColumn("target", F.lit(0.0))
    share, before = total / weight, None
    while True:
        above = F.lit(share) * F.col("s_weight") > most * F.col("s_size")
        full, taken, n = each.where(above).agg(F.sum("s_size"), F.sum("s_weight"), F.count("*")).first()
        if n == before or not n or taken == weight:
            break
        share, before = (total - most * full) / (weight - taken), n
    return each.withColumn("target", F.when(above, F.lit(float(most)) * F.col("s_size")).otherwise(F.lit(share) * F.col("s_weight")))


def beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, ...) with the row of ``plan`` of their source, broadcast if it is small."""
    size = plan.agg(F.sum(F.coalesce(F.octet_length("s_source"), F.lit(0)) + 128)).first()[0] or 0
    return rows.join(F.broadcast(plan) if size <= MOST_BROADCAST else plan, F.col("source").eqNullSafe(F.col("s_source")))


def with_cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with n_passes, and c_key, c_doc, c_size, c_taken: the document at the cut and the words that it gives.

    The latter are null where the passes meet the target without a rest.
    """
    words = F.floor("target").cast("long")
    plan = plan.withColumn("n_passes", F.when(F.col("s_size") > 0, F.call_function("div", words, F.col("s_size"))).otherwise(F.lit(0)).cast("long"))
    plan = settle(plan.withColumn("rest", words - F.col("n_passes") * F.col("s_size")))
    bins = F.greatest(F.lit(1), F.ceil(F.col("s_rows") / RANGE_ROWS)).cast("long")
    own = beside(rows.where("size > 0"), plan.where("rest > 0")).withColumn("range", F.shiftright(F.shiftright("key", KEY_BITS - RANGE_BITS) * bins, RANGE_BITS))
    sums = own.groupBy("s_id", "range").agg(F.sum("size").alias("range_size"))
    order = Window.partitionBy("s_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s_id", "range", "range_size", F.coalesce(F.sum("range_size").over(order), F.lit(0)).alias("offset"))
    sums = sums.join(plan.select("s_id", "rest"), "s_id").where("offset <= rest and rest < offset + range_size")
    sums = settle(sums.select(F.col("s_id").alias("h_id"), F.col("range").alias("h_range"), "offset"))
    near = beside(own.select("source", "doc_id", "size", "key", "range"), plan.select("s_source", "s_id", "rest")).join(sums, (F.col("s_id") == F.col("h_id")) & (F.col("range") == F.col("h_range")))
    equal = near.groupBy("s_id", "rest", "offset", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("s_id").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    at = equal.withColumn("left", F.col("rest") - ahead).where("left >= 0 and left < size * copies")
    at = at.select(F.col("s_id").alias("h_id"), F.col("key").alias("c_key"), F.col("doc_id").alias("c_doc"), F.col("size").alias("c_size"), F.expr("left div copies").alias("c_taken"))
    return settle(plan.join(at, F.col("s_id") == F.col("h_id"), "left").drop("h_id"))


def words_of_the_rest():
    """What a row gives to the rest of its source's target."""
    own, cut = F.struct("key", "doc_id", "size"), F.struct(F.col("c_key").alias("key"), F.col("c_doc").alias("doc_id"), F.col("c_size").alias("size"))
    return F.when(F.col("c_key").isNull(), 0).when(own < cut, F.col("size")).when(own == cut, F.col("c_taken")).otherwise(0).cast("long")


def sized(docs: DataFrame, seed: str) -> list:
    return ["doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key")]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = settle(docs.select(*sized(docs, seed)))
    cut = beside(rows, with_cuts(rows, targets(rows, weights, most)))
    return cut.select("doc_id", "size", F.col("s_size").alias("source_size"), "target", (F.col("n_passes") * F.col("size") + words_of_the_rest()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Texts are kept whole: a document at the cut comes once more if at least half
    of its words are within the budget. Documents without words are in no pass.
    The plan is made from narrow rows; the texts are read once more to be written.
    """
    names = docs.columns
    rows = settle(docs.select(*sized(docs, seed)))
    plan = with_cuts(rows, targets(rows, weights, most))
    cut = beside(docs.select(F.struct(*names).alias("doc"), *sized(docs, seed)), plan)
    times = F.when(F.col("size") > 0, F.col("n_passes") + (2 * words_of_the_rest() >= F.col("size")).cast("long")).otherwise(0)
    return cut.select("doc", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("again")).select("doc.*")
