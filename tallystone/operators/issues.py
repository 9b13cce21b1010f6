"""Permission issues: owners, numbering, counts, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import default_name
from .numbering import numbered_by

UNKNOWN = "__unknown__"


def owned(events: DataFrame, usernames: DataFrame) -> DataFrame:
    """uid, user, item_type, error, path: uid 0 without a name is nobody known, others without one ``uid-N``."""
    rows = events.join(usernames, "uid", "left")
    user = F.coalesce("username", F.when(F.col("uid") == 0, UNKNOWN).otherwise(default_name(F.col("uid"))))
    return rows.select("uid", user.alias("user"), F.col("kind").alias("item_type"), F.col("errcode").alias("error"), "path")


def numbered(issues: DataFrame) -> DataFrame:
    """id from 1 in (uid, path, error, item_type) order."""
    rows = numbered_by(issues, "id", "uid", "path", "error", "item_type")
    return rows.select((F.col("id") + 1).alias("id"), "user", "item_type", "error", "path")


def by_user(issues: DataFrame) -> DataFrame:
    """user, issues, directories, files."""
    return issues.groupBy("user").agg(F.count("*").alias("issues"), F.sum((F.col("item_type") == "directory").cast("long")).alias("directories"), F.sum((F.col("item_type") != "directory").cast("long")).alias("files"))


def of_user(issues: DataFrame, user: str, top: int, pattern: str = "") -> DataFrame:
    """id, item_type, error, path, total: the user's first issues whose path fits, and how many fit in all."""
    rows = issues.where(F.col("user") == user)
    if pattern:
        rows = rows.where(F.col("path").ilike(f"%{pattern}%"))
    total = rows.agg(F.count("*").alias("total"))
    return rows.select("id", "item_type", "error", "path").orderBy("id").limit(top).join(F.broadcast(total))


def grouped(issues: DataFrame, most: int = 100) -> DataFrame:
    """user, count, inaccessible_items: of each user how many, and the first ``most`` by path as (path, type, error)."""
    order = Window.partitionBy("user").orderBy("path", "error", "item_type")
    first = issues.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    items = first.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("path", F.col("item_type").alias("type"), "error"))).alias("inaccessible_items"))
    return issues.groupBy("user").agg(F.count("*").alias("count")).join(items, "user")
