"""Usage by team, configured user and other user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import named

OTHER = "Other"


def classified(sizes: DataFrame, usernames: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """username, used, inodes, configured, team_id, team of every uid of ``sizes`` (uid, size, files).

    Users outside the configuration have no team; a configured user of an unknown
    team belongs to ``Other``.
    """
    rows = named(sizes, usernames).groupBy("username").agg(F.sum("size").alias("used"), F.sum("files").alias("inodes"))
    rows = rows.join(users.select(F.col("name").alias("username"), "team_id", F.lit(True).alias("configured")), "username", "left").join(teams, "team_id", "left")
    configured = F.coalesce("configured", F.lit(False))
    return rows.select("username", "used", "inodes", configured.alias("configured"), "team_id", F.when(configured, F.coalesce("team", F.lit(OTHER))).alias("team"))


def team_usage(rows: DataFrame) -> DataFrame:
    """section, name, used, team_id: every team, and a row ``Other`` with the sum of all other users."""
    teams = rows.where("configured").groupBy(F.col("team").alias("name")).agg(F.sum("used").alias("used"), F.min(F.when(F.col("team") != OTHER, F.col("team_id"))).alias("team_id"))
    other = rows.where("not configured").agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used")).select(F.lit(OTHER).alias("name"), "used", F.lit(None).cast("string").alias("team_id"))
    return teams.unionByName(other).select(F.lit("team").alias("section"), "name", "used", "team_id")


def user_usage(rows: DataFrame) -> DataFrame:
    """section, name, used, team_id of configured and other users."""
    return rows.select(F.when(F.col("configured"), "user").otherwise("other").alias("section"), F.col("username").alias("name"), "used", "team_id")


def summary(rows: DataFrame) -> DataFrame:
    """The usage summary: teams, users and others in one table."""
    return team_usage(rows).unionByName(user_usage(rows))


def console_teams(rows: DataFrame) -> DataFrame:
    """team, used as the console shows it: there the other users' sum replaces what ``Other`` had."""
    teams = rows.where("configured").where(F.col("team") != OTHER).groupBy("team").agg(F.sum("used").alias("used"))
    return teams.unionByName(rows.where("not configured").agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used")).select(F.lit(OTHER).alias("team"), "used"))


def targeted(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """seq, name, used, inodes of the requested users (seq, name), 0 where nothing was found."""
    found = rows.select(F.col("username").alias("name"), "used", "inodes")
    return requested.join(found, "name", "left").select("seq", "name", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("inodes", F.lit(0)).alias("inodes"))


def team_members(users: DataFrame, teams: DataFrame, pattern: str = "") -> DataFrame:
    """team, name, listed: users by team; users of unknown teams separately. ``pattern``: part of a team's name."""
    known = users.join(teams, "team_id").select("team", "name", F.lit("team").alias("listed"))
    lost = users.join(teams, "team_id", "left_anti").select(F.lit(OTHER).alias("team"), "name", F.lit("unknown").alias("listed"))
    return known.unionByName(lost).where(F.contains(F.lower("team"), F.lit(pattern.lower())))


def next_team_id(teams: DataFrame) -> DataFrame:
    return teams.agg((F.coalesce(F.max(F.col("team_id").cast("long")), F.lit(0)) + 1).alias("team_id"))


def run_users(requested: DataFrame, users: DataFrame) -> DataFrame:
    """The requested names with their configured team, null if none."""
    return requested.join(users, "name", "left").select("name", "team_id")


def team_counts(users: DataFrame, teams: DataFrame) -> DataFrame:
    """team, users: how many users (name, team_id) each team (team_id, team) has, those without any too."""
    return teams.join(users, "team_id", "left").groupBy("team").agg(F.count("name").alias("users"))
