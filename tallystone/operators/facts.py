"""Fact tables of one scan: users, directories, files, names, extensions, meta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import default_name
from ..functions.paths import basename, extension, parent_or_root
from .numbering import numbered_by

FIRST_SYNTHETIC_UID = 1_000_000_000


def named(rows: DataFrame, usernames: DataFrame) -> DataFrame:
    """``rows`` (uid, ...) with username, ``uid-N`` where there is none."""
    return rows.join(usernames, "uid", "left").withColumn("username", F.coalesce("username", default_name(F.col("uid"))))


def interned(names: DataFrame, usernames: DataFrame) -> DataFrame:
    """username, uid: the smallest uid of the name; names without one get numbers from 1,000,000,000 by name."""
    known = usernames.groupBy("username").agg(F.min("uid").alias("known"))
    rows = names.select("username").distinct().join(known, "username", "left")
    extra = numbered_by(rows.where("known is null").select("username"), "extra", "username")
    return rows.join(extra, "username", "left").select("username", F.coalesce("known", F.col("extra") + FIRST_SYNTHETIC_UID).alias("uid"))


def dictionary(values: DataFrame, value: str, number: str) -> DataFrame:
    """Each distinct value with a dense number from 0 in value order."""
    return numbered_by(values.select(value).where(F.col(value).isNotNull()).distinct(), number, value)


def file_rows(files: DataFrame, tree: DataFrame) -> DataFrame:
    """dir_id, name, ext, uid, size of every file; files whose directory is not in the tree belong to the root."""
    ids = tree.select(F.col("path").alias("dir"), "dir_id")
    rows = files.select(parent_or_root(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), "uid", "size")
    return rows.join(ids, "dir", "left").select(F.coalesce("dir_id", F.lit(0)).cast("long").alias("dir_id"), "name", "ext", "uid", "size")


def user_rows(direct: DataFrame, usernames: DataFrame, teams_of: DataFrame) -> DataFrame:
    """uid, username, team_id, total_files, total_dirs, total_size. ``teams_of``: name, team_id; no team is empty.

    total_dirs counts directories where the user has a positive size.
    """
    sums = direct.groupBy("uid").agg(F.sum("files").alias("total_files"), F.sum((F.col("size") > 0).cast("long")).alias("total_dirs"), F.sum("size").alias("total_size"))
    rows = named(sums, usernames).join(teams_of.select(F.col("name").alias("username"), "team_id"), "username", "left")
    return rows.select("uid", "username", F.coalesce("team_id", F.lit("")).alias("team_id"), "total_files", "total_dirs", "total_size")


def user_dir_rows(direct: DataFrame, tree: DataFrame) -> DataFrame:
    """dir_id, uid, parent_id, path, size, files of every directory of a user."""
    return direct.join(tree.select(F.col("path").alias("dir"), "dir_id", "parent_id"), "dir", "left").select("dir_id", "uid", "parent_id", F.col("dir").alias("path"), "size", "files")


def extension_rows(files: DataFrame) -> DataFrame:
    """ext, files, size."""
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def owners(tree: DataFrame, seen: DataFrame) -> DataFrame:
    """path, owner_uid of the directories of the tree; of several owners the smallest."""
    return seen.join(tree.select("path"), "path", "left_semi").groupBy("path").agg(F.min("owner_uid").alias("owner_uid"))


def meta_rows(values: dict[str, str], spark) -> DataFrame:
    """key, value; a later value of a key replaces an earlier one."""
    return spark.createDataFrame(sorted(values.items()), "key string, value string")


def last_of_key(rows: DataFrame) -> DataFrame:
    """key, value with the highest ``seq`` of each key."""
    return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def meta_values(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value of each asked key (key), empty if there is none."""
    return keys.select("key").distinct().join(meta, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"))


def meta_value(meta: DataFrame, key: str) -> DataFrame:
    """One row: the key's value, empty if there is none."""
    return meta.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def owner_uids(direct: DataFrame, usernames: DataFrame) -> DataFrame:
    """uid of everybody who has files or a name."""
    return direct.select("uid").union(usernames.select("uid")).distinct()


def owner_weights(parts: DataFrame, tree: DataFrame) -> DataFrame:
    """dir_id, uid, weight: the parts (dir, uid, size) of each directory and owner added up, where they hold any bytes."""
    ids = tree.select(F.col("path").alias("dir"), "dir_id")
    return parts.join(ids, "dir").groupBy("dir_id", "uid").agg(F.sum("size").alias("weight")).where("weight > 0")


def row_count(rows: DataFrame) -> DataFrame:
    """One row: how many rows a table has."""
    return rows.agg(F.count("*").alias("rows"))
