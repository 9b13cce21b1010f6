"""Permission events as tab-separated text: ``P uid kind code path``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sanitize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    """uid, kind, errcode, path of the well-formed lines; the others are left out one by one. Tabs stay in paths."""
    part = F.split("value", "\t", 5)
    ok = (F.size(part) == 5) & (part[0] == "P") & F.regexp_like(part[1], F.lit("^[0-9]{1,10}$"))
    return lines.where(ok).select(part[1].cast("long").alias("uid"), part[2].alias("kind"), part[3].alias("errcode"), sanitize(part[4]).alias("path"))
