"""The driver's tables read as storage metadata (files, users, teams, owners, snapshots, issues).

Every line item is a file below /region/nation/segment/oN; its supplier is the
owner. (l_orderkey, l_linenumber) is not unique, which plays hard links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, uid, size, ino, dev, tie of every directory entry."""
    place = (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "r_name", "n_name", "c_mktsegment", F.col("r_regionkey").cast("long").alias("dev"))
    )
    path = F.concat(
        F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment",
        F.lit("/o"), (F.col("l_orderkey") % 7).cast("string"),
        F.lit("/l"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("."), "l_returnflag", "l_linestatus",
    )
    items = read(spark, sf_dir, "lineitem").join(place, F.col("l_orderkey") == F.col("o_orderkey"))
    return items.select(
        path.alias("path"),
        F.col("l_suppkey").alias("uid"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ino"),
        "dev",
        F.col("l_partkey").alias("tie"),
    )


def with_link_count(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nlink", F.count("*").over(Window.partitionBy("ino", "dev")))


def usernames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, username; every tenth uid has no name."""
    return read(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 9").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("username"))


def configured_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, team_id of the users that the configuration lists."""
    return read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 5).cast("string").alias("team_id"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, team; one team that users refer to is missing."""
    return read(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("string").alias("team_id"), F.col("r_name").alias("team"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, report, source, name, used: a usage report for each year of shipping."""
    year = F.year("l_shipdate")
    items = read(spark, sf_dir, "lineitem").groupBy(year.alias("year"), "l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("used"))
    return items.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.unix_date(F.make_date("year", F.lit(1), F.lit(1))).cast("long").alias("day"),
        F.concat(F.lit("report-"), F.col("year").cast("string")).alias("report"),
        F.when(F.col("s_suppkey") % 5 != 0, "user").otherwise("other").alias("source"),
        F.col("s_name").alias("name"),
        "used",
    )


def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: tab-separated permission events, some of them malformed."""
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    kind = F.when(F.col("event_id") % 3 == 0, "directory").otherwise("file")
    pick = F.col("event_id") % 4
    message = F.when(pick == 0, "open: Permission denied (os error 13)").when(pick == 1, "stat: No such file or directory").when(pick == 2, "read: Input/output error (os error 5)").otherwise("unknown trouble")
    path = F.concat(F.lit("/u"), (F.col("user_id") % 17).cast("string"), F.lit("/e\t"), F.col("event_id").cast("string"))
    line = F.concat_ws("\t", F.lit("P"), F.when(F.col("event_id") % 19 == 0, "0").otherwise(F.col("user_id").cast("string")), kind, formats.error_code(message), path)
    return rows.select(F.when(F.col("event_id") % 23 == 0, F.concat_ws("\t", F.lit("P"), kind)).when(F.col("event_id") % 29 == 0, F.concat(F.lit("X"), line)).otherwise(line).alias("value"))
