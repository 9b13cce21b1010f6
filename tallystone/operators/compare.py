"""Comparison of usage snapshots: densified series, growth, trend, selection, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREND_SHARE = 0.7
MOST_USERS = 10


def latest_of_day(rows: DataFrame) -> DataFrame:
    """``rows`` (day, seq, ...) of the report listed last for each day."""
    last = rows.groupBy("day").agg(F.max("seq").alias("seq"))
    return rows.join(last, ["day", "seq"], "left_semi")


def series(rows: DataFrame) -> DataFrame:
    """day, name, used for every day and name; 0 where the report has no such user.

    A name listed as configured user and as other counts as the first, or the
    second where the first is 0. Days and names are dimension tables: the
    densified table has days x names rows by definition.
    """
    one = rows.groupBy("day", "name").agg(F.max(F.when(F.col("source") == "user", F.col("used"))).alias("own"), F.max(F.when(F.col("source") == "other", F.col("used"))).alias("other"))
    one = one.select("day", "name", F.coalesce(F.nullif("own", F.lit(0)), "other", F.lit(0)).alias("used"))
    days = one.groupBy(F.lit(1).alias("all")).agg(F.sort_array(F.collect_set("day")).alias("days"))
    held = one.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("day", "used"))).alias("held"))
    full = held.join(F.broadcast(days)).select("name", "held", F.explode("days").alias("day"))
    return full.select("day", "name", F.coalesce(F.element_at("held", F.col("day")), F.lit(0)).cast("long").alias("used"))


def growth(points: DataFrame) -> DataFrame:
    """name, growth, percent, trend of each name's series (day, name, used).

    The base is the first value, or the first positive one if that is 0; without
    a positive base there is no percentage. Under two points: 0, none, ``-``.
    """
    order = Window.partitionBy("name").orderBy("day")
    step = points.withColumn("diff", F.col("used") - F.lag("used").over(order))
    sums = step.groupBy("name").agg(
        F.count("*").alias("n"),
        F.min_by("used", "day").alias("first"),
        F.max_by("used", "day").alias("last"),
        F.min_by(F.when(F.col("used") > 0, F.col("used")), F.when(F.col("used") > 0, F.col("day"))).alias("positive"),
        F.sum((F.col("diff") > 0).cast("long")).alias("up"),
        F.sum((F.col("diff") < 0).cast("long")).alias("down"),
        (F.max("used") == F.min("used")).alias("flat"),
    )
    base = F.when(F.col("first") == 0, F.coalesce("positive", F.lit(0))).otherwise(F.col("first"))
    change = F.col("last") - base
    steps = (F.col("n") - 1) * F.lit(TREND_SHARE)
    trend = F.when((F.col("n") < 3) | F.col("flat"), "-").when(F.col("up") > steps, "^").when(F.col("down") > steps, "v").otherwise("~")
    return sums.select(
        "name",
        F.when(F.col("n") < 2, F.lit(0)).otherwise(change).cast("long").alias("growth"),
        F.when((F.col("n") >= 2) & (base > 0), change.cast("double") / base.cast("double") * 100).alias("percent"),
        F.when(F.col("n") < 2, "-").otherwise(trend).alias("trend"),
    )


def selected(points: DataFrame, by: str = "growth", most: int = MOST_USERS) -> DataFrame:
    """name of the users that a comparison shows: all, or the first ``most`` by growth or by usage."""
    days, names = points.agg(F.count_distinct("day"), F.count_distinct("name")).first()
    if names <= most:
        return points.select("name").distinct()
    if by == "growth" and days >= 2:
        return growth(points).orderBy(F.desc(F.coalesce("percent", F.lit(0.0))), F.desc("growth"), "name").limit(most).select("name")
    return points.groupBy("name").agg(F.sum("used").alias("total")).orderBy(F.desc("total"), "name").limit(most).select("name")


def pivoted(points: DataFrame, names: list[str]) -> DataFrame:
    """day and a column for each name."""
    return points.groupBy("day").pivot("name", names).agg(F.sum("used"))


def names_of(*frames: DataFrame) -> DataFrame:
    """name: every name of the given tables once."""
    out = frames[0].select("name")
    for f in frames[1:]:
        out = out.union(f.select("name"))
    return out.distinct()
