"""Analysis of a mount table, given as lines in file order (line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import under


def parsed(lines: DataFrame) -> DataFrame:
    """line_no, device, fs_root, mount_point of the lines with at least five fields."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(part) >= 5).select("line_no", part[2].alias("device"), part[3].alias("fs_root"), part[4].alias("mount_point"))


def duplicate_mounts(lines: DataFrame, root: str) -> DataFrame:
    """mount_point of later mounts of a source below ``root`` whose first mount is already under it."""
    root = root.rstrip("/") or "/"
    rows = parsed(lines).withColumn("inside", under(F.col("mount_point"), root))
    order = Window.partitionBy("device", "fs_root").orderBy("line_no")
    rows = rows.withColumn("first_inside", F.first("inside").over(order)).withColumn("place", F.row_number().over(order))
    return rows.where((F.col("place") > 1) & F.col("inside") & F.col("first_inside") & (F.col("mount_point") != root)).select("mount_point").distinct()


def seen_twice(mounts: DataFrame) -> DataFrame:
    """dev, ino of roots that several mount points show."""
    return mounts.groupBy("dev", "ino").agg(F.count("*").alias("n")).where("n > 1").select("dev", "ino")


def foreign(dirs: DataFrame, root_dev: int) -> DataFrame:
    """dev, path: each other device that the walk met (dev, path), once, with the smallest path."""
    return dirs.where(F.col("dev") != root_dev).groupBy("dev").agg(F.min("path").alias("path"))
