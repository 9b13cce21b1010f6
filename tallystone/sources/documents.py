"""JSON documents: configuration, report snapshots; passwd, capacity and mount tables of this host."""

from __future__ import annotations

import glob
import json
import os
import pwd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = (
    "date long, directory string, general_system struct<total:long,used:long,available:long>, "
    "team_usage array<struct<name:string,used:long,team_id:string>>, user_usage array<struct<name:string,used:long,team_id:string>>, other_usage array<struct<name:string,used:long>>"
)


def load_json(path: str) -> dict:
    """The document; missing or broken: empty."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def expand(patterns: list[str]) -> list[str]:
    """Files of the patterns in order; a pattern without a match stays as it is. One argument may hold several."""
    if len(patterns) == 1 and " " in patterns[0]:
        patterns = patterns[0].split()
    return [f for p in patterns for f in (sorted(glob.glob(p)) or [p])]


def reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """seq, day, source, name, used of report files, in the order given."""
    order = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "seq long, file string")
    rows = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(list(paths)).withColumn("file", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))
    rows = rows.join(F.broadcast(order), "file").withColumn("day", F.floor(F.col("date") / 86400).cast("long"))
    own = rows.select("seq", "day", F.lit("user").alias("source"), F.inline("user_usage")).select("seq", "day", "source", "name", "used")
    other = rows.select("seq", "day", F.lit("other").alias("source"), F.inline("other_usage")).select("seq", "day", "source", "name", "used")
    return own.unionByName(other)


def config_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """users (name, team_id) and teams (team_id, team); ids as strings."""
    users = [(u["name"], None if u.get("team_id") is None else str(u["team_id"])) for u in config.get("users", [])]
    teams = [(str(t["team_id"]), t["name"]) for t in config.get("teams", [])]
    return spark.createDataFrame(users, "name string, team_id string"), spark.createDataFrame(teams, "team_id string, team string")


def host_usernames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.pw_uid, p.pw_name) for p in pwd.getpwall()], "uid long, username string")


def username_of(uid: int) -> str:
    """The host's name of a uid, ``uid-N`` without one."""
    try:
        return pwd.getpwuid(uid).pw_name
    except KeyError:
        return f"uid-{uid}"


def owner_of(path: str) -> str | None:
    """Who owns a path of this host; none if it cannot be asked. Links count themselves."""
    try:
        return username_of(os.lstat(path).st_uid)
    except OSError:
        return None


def unreadable(paths: list[str]) -> list[str]:
    """What there is to say about report files that are missing or hold no report."""
    return [f"Not found: {p}" if not os.path.exists(p) else f"No report: {p}" for p in paths if "date" not in load_json(p)]


def capacity(path: str) -> dict[str, int]:
    """Bytes and inodes of the file system; zeros if it cannot be asked."""
    names = ("total", "used", "available", "inodes_total", "inodes_used", "inodes_free")
    try:
        s = os.statvfs(path)
    except OSError:
        return dict.fromkeys(names, 0)
    total, free = s.f_blocks * s.f_frsize, s.f_bfree * s.f_frsize
    return dict(zip(names, (total, total - free, s.f_bavail * s.f_frsize, s.f_files, s.f_files - s.f_ffree, s.f_ffree), strict=True))


def mount_lines(spark: SparkSession, path: str = "/proc/self/mountinfo") -> DataFrame:
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        lines = []
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
