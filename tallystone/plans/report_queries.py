"""Summaries, per-user reports, comparison of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import notify
from ..operators import classify, compare, facts, reports, tree
from ..registry import query
from ..sources import fixtures
from .base import CLASSIFIED, CONFIG, DD, FE, MINE, TREE, UN, Scan
from .tree_queries import TREEMAP

SUMMARY = CLASSIFIED + """, summary AS (
  SELECT 'team' AS section, team AS name, CAST(sum(used) AS BIGINT) AS used, CASE WHEN team <> 'Other' THEN min(team_id) END AS team_id FROM cl WHERE configured GROUP BY team
  UNION ALL SELECT 'team', 'Other', CAST(coalesce(sum(used), 0) AS BIGINT), NULL FROM cl WHERE NOT configured
  UNION ALL SELECT CASE WHEN configured THEN 'user' ELSE 'other' END, username, used, team_id FROM cl)"""


@query("rq1_usage_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def usage_summary(spark, sf_dir):
    return classify.summary(Scan(spark, sf_dir).classified)


@query("rq1_inodes", f"WITH {CLASSIFIED} SELECT username AS name, inodes FROM cl")
def user_inode_counts(spark, sf_dir):
    return Scan(spark, sf_dir).classified.select(F.col("username").alias("name"), "inodes")


@query("rq3_targeted", f"WITH {CLASSIFIED} SELECT seq, r.name, coalesce(used, 0) AS used, coalesce(inodes, 0) AS inodes FROM (VALUES (1, 'Supplier#000000003'), (2, 'nobody'), (3, 'Supplier#000000001')) r(seq, name) LEFT JOIN cl ON cl.username = r.name")
def targeted_summary(spark, sf_dir):
    wanted = spark.createDataFrame([(1, "Supplier#000000003"), (2, "nobody"), (3, "Supplier#000000001")], "seq int, name string")
    return classify.targeted(wanted, Scan(spark, sf_dir).classified)


@query("rq4_standard_report", f"WITH {SUMMARY}, top AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY used DESC, name) AS place FROM summary WHERE section <> 'team') SELECT section, name, used, team_id FROM top WHERE place <= 10 AND name[-1] IN ('1', '3', '5', '7')")
def standard_report(spark, sf_dir):
    rows = classify.summary(Scan(spark, sf_dir).classified)
    return reports.standard_report(rows).where(F.substring("name", -1, 1).isin("1", "3", "5", "7"))


@query("rq4_checked_users", f"WITH {CLASSIFIED} SELECT username AS name, used, CAST(used AS DOUBLE) / 1000000000.0 * 100 AS percent FROM cl WHERE username IN ('Supplier#000000003', 'uid-9')")
def checked_users(spark, sf_dir):
    rows = classify.user_usage(Scan(spark, sf_dir).classified)
    return reports.checked_users(rows, ["Supplier#000000003", "uid-9"], 1_000_000_000)


@query("rq4_top_users", f"WITH {SUMMARY} SELECT name, used FROM summary WHERE section = 'user' ORDER BY used DESC, name LIMIT 20")
def top_users(spark, sf_dir):
    return reports.top_usage(classify.user_usage(Scan(spark, sf_dir).classified).where("section = 'user'").select("name", "used"), 20)


@query("so_notification", f"WITH {SUMMARY}, top AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY used DESC, name) AS place FROM summary WHERE section <> 'team') SELECT section, name, used FROM top WHERE place <= 10")
def notification(spark, sf_dir):
    return notify.top_rows(classify.user_usage(Scan(spark, sf_dir).classified))


@query("rq14_console_teams", f"WITH {CLASSIFIED} SELECT team, CAST(sum(used) AS BIGINT) AS used FROM cl WHERE configured AND team <> 'Other' GROUP BY team UNION ALL SELECT 'Other', CAST(coalesce(sum(used), 0) AS BIGINT) FROM cl WHERE NOT configured")
def console_teams(spark, sf_dir):
    return classify.console_teams(Scan(spark, sf_dir).classified)


@query("rq13_team_members", f"WITH {CONFIG} SELECT coalesce(team, 'Other') AS team, name, CASE WHEN team IS NULL THEN 'unknown' ELSE 'team' END AS listed FROM cu LEFT JOIN tm USING (team_id) WHERE contains(lower(coalesce(team, 'Other')), 'a')")
def team_members(spark, sf_dir):
    s = Scan(spark, sf_dir)
    return classify.team_members(s.users, s.teams, "A")


@query("rq13_next_team", f"WITH {CONFIG} SELECT coalesce(max(CAST(team_id AS BIGINT)), 0) + 1 AS team_id FROM tm")
def next_team(spark, sf_dir):
    return classify.next_team_id(Scan(spark, sf_dir).teams)


@query("rq13_run_users", f"WITH {CONFIG} SELECT r.name, cu.team_id FROM (VALUES ('Supplier#000000003'), ('Supplier#000000005'), ('nobody')) r(name) LEFT JOIN cu USING (name)")
def run_users(spark, sf_dir):
    wanted = spark.createDataFrame([("Supplier#000000003",), ("Supplier#000000005",), ("nobody",)], "name string")
    return classify.run_users(wanted, Scan(spark, sf_dir).users)


@query("rq15_unknown_users", f"WITH {UN} SELECT r.name FROM (VALUES ('Supplier#000000003'), ('Supplier#000000009'), ('nobody')) r(name) WHERE name NOT IN (SELECT username FROM un)")
def unknown_users(spark, sf_dir):
    wanted = spark.createDataFrame([("Supplier#000000003",), ("Supplier#000000009",), ("nobody",)], "name string")
    return reports.unknown_users(wanted, Scan(spark, sf_dir).usernames)


@query("rq6_user_dirs", f"WITH {TREE}, {MINE} SELECT path, used FROM mine WHERE uid = 7 ORDER BY used DESC, path LIMIT 12")
def user_dirs(spark, sf_dir):
    return reports.user_dirs(Scan(spark, sf_dir).direct, 7, 12)


@query("rq6_user_dirs_search", f"WITH {TREE}, {MINE} SELECT path, used FROM mine WHERE uid = 7 AND contains(lower(path), 'nation_1')")
def user_dirs_search(spark, sf_dir):
    return reports.user_dirs(Scan(spark, sf_dir).direct, 7, 12, "Nation_1")


@query("rq7_user_files", f"WITH {FE} SELECT path, size FROM fe WHERE uid = 7 ORDER BY size DESC, path LIMIT 25")
def user_files(spark, sf_dir):
    return reports.user_files(Scan(spark, sf_dir).files, 7, 25)


@query("rq7_user_files_search", f"WITH {FE} SELECT path, size FROM fe WHERE uid = 7 AND contains(lower(string_split(path, '/')[-1]), 'l1') ORDER BY size DESC, path LIMIT 25")
def user_files_search(spark, sf_dir):
    return reports.user_files(Scan(spark, sf_dir).files, 7, 25, "L1")


@query("rq8_user_inodes", f"WITH {DD} SELECT dir AS path, files FROM dd WHERE uid = 7 AND dir ILIKE '%a_ia%' ORDER BY files DESC, path LIMIT 10")
def user_inodes(spark, sf_dir):
    return reports.user_inodes(Scan(spark, sf_dir).direct, 7, 10, "a_ia")


PAGE = "SELECT path, size FROM (SELECT path, size, row_number() OVER (ORDER BY size DESC, path) AS place FROM fe WHERE uid = 7 {where}) WHERE place BETWEEN {a} AND {b}"


@query("so_files_page", f"WITH {FE} {PAGE.format(where='', a=21, b=40)}")
def files_page(spark, sf_dir):
    files = Scan(spark, sf_dir).files
    last = reports.files_page(files, 7, 20).orderBy("size", F.desc("path")).first()
    return reports.files_page(files, 7, 20, (last["size"], last["path"]))


@query("so_files_page_of_ext", f"WITH {FE} {PAGE.format(where="AND lower(regexp_extract(path, '[.]([^./]*)$', 1)) = 'af'", a=6, b=10)}")
def files_page_of_ext(spark, sf_dir):
    files = Scan(spark, sf_dir).files
    last = reports.files_page(files, 7, 5, ext="af").orderBy("size", F.desc("path")).first()
    return reports.files_page(files, 7, 5, (last["size"], last["path"]), "af")


@query("so_dirs_page", f"WITH {TREE} SELECT dir_id, path, size FROM (SELECT dir_id, dd.dir AS path, size, row_number() OVER (ORDER BY size DESC, dir_id) AS place FROM dd JOIN tree ON tree.path = dd.dir WHERE uid = 7) WHERE place BETWEEN 6 AND 10")
def dirs_page(spark, sf_dir):
    s = Scan(spark, sf_dir).stage()
    dirs = facts.user_dir_rows(s.direct.where("uid = 7"), s.tree)
    last = reports.dirs_page(dirs, 7, 5).orderBy("size", F.desc("dir_id")).first()
    return reports.dirs_page(dirs, 7, 5, (last["size"], last["dir_id"]))


@query("so_flat_search", f"WITH {TREEMAP} SELECT path, total_size, count(*) OVER () AS matches FROM treemap WHERE starts_with(path, '/ASIA/') AND string_split(path, '/')[-1] ILIKE '%o%' ORDER BY total_size DESC, path LIMIT 10")
def flat_search(spark, sf_dir):
    rows = tree.subtree_usage(Scan(spark, sf_dir).direct).select("path", "total_size")
    return reports.flat_search(rows, "o", "/ASIA", 10)


@query("so_flat_user_search", f"WITH {DD} SELECT dir AS path, size FROM dd WHERE uid = 7 AND starts_with(dir, '/ASIA/') AND string_split(dir, '/')[-1] ILIKE '%o%' ORDER BY size DESC, path LIMIT 10")
def flat_user_search(spark, sf_dir):
    return reports.flat_user_search(Scan(spark, sf_dir).direct, 7, "o", "/ASIA", 10)


@query("rq12_export", f"WITH {TREE}, {MINE}, {UN} SELECT 'dir' AS kind, coalesce(username, 'uid-' || CAST(m.uid AS VARCHAR)) AS username, path, used AS size FROM mine m LEFT JOIN un ON m.uid = un.uid UNION ALL SELECT 'file', coalesce(username, 'uid-' || CAST(fe.uid AS VARCHAR)), path, size FROM fe LEFT JOIN un ON fe.uid = un.uid")
def export(spark, sf_dir):
    s = Scan(spark, sf_dir)
    return reports.export_rows(s.files, s.direct, s.usernames)


SNAPS = """snaps AS (
  SELECT CAST(make_date(year(l_shipdate), 1, 1) - DATE '1970-01-01' AS BIGINT) AS day, CASE WHEN s_suppkey % 5 <> 0 THEN 'user' ELSE 'other' END AS source, s_name AS name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS used
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
points AS (SELECT d.day, n.name, CAST(coalesce(sum(used), 0) AS BIGINT) AS used FROM (SELECT DISTINCT day FROM snaps) d CROSS JOIN (SELECT DISTINCT name FROM snaps) n LEFT JOIN snaps s ON s.day = d.day AND s.name = n.name GROUP BY 1, 2),
steps AS (SELECT *, used - lag(used) OVER (PARTITION BY name ORDER BY day) AS diff FROM points),
g AS (
  SELECT name, count(*) AS n, arg_max(used, day) AS last, arg_min(used, day) AS first, arg_min(used, day) FILTER (used > 0) AS positive,
    count(*) FILTER (diff > 0) AS ups, count(*) FILTER (diff < 0) AS downs, min(used) = max(used) AS flat FROM steps GROUP BY name),
based AS (SELECT *, CASE WHEN first = 0 THEN coalesce(positive, 0) ELSE first END AS base FROM g),
growth AS (
  SELECT name, CASE WHEN n < 2 THEN 0 ELSE last - base END AS growth, CASE WHEN n >= 2 AND base > 0 THEN CAST(last - base AS DOUBLE) / CAST(base AS DOUBLE) * 100 END AS percent,
    CASE WHEN n < 3 OR flat THEN '-' WHEN ups > (n - 1) * CAST(0.7 AS DOUBLE) THEN '^' WHEN downs > (n - 1) * CAST(0.7 AS DOUBLE) THEN 'v' ELSE '~' END AS trend FROM based)"""


def points(spark, sf_dir):
    """The snapshots, densified."""
    return compare.series(fixtures.snapshots(spark, sf_dir))


@query("wn_series", f"WITH {SNAPS} SELECT day, name, used FROM points")
def series(spark, sf_dir):
    return points(spark, sf_dir)


@query("wn_growth", f"WITH {SNAPS} SELECT name, growth, percent, trend FROM growth")
def growth(spark, sf_dir):
    return compare.growth(points(spark, sf_dir))


@query("rq5_selected_growth", f"WITH {SNAPS} SELECT name FROM growth ORDER BY coalesce(percent, 0) DESC, growth DESC, name LIMIT 10")
def selected_growth(spark, sf_dir):
    return compare.selected(points(spark, sf_dir))


@query("rq5_selected_usage", f"WITH {SNAPS} SELECT name FROM points GROUP BY name ORDER BY sum(used) DESC, name LIMIT 10")
def selected_usage(spark, sf_dir):
    return compare.selected(points(spark, sf_dir), "usage")


@query("rq5_pivot", f"WITH {SNAPS} SELECT day, CAST(sum(used) FILTER (name = 'Supplier#000000001') AS BIGINT) AS \"Supplier#000000001\", CAST(sum(used) FILTER (name = 'Supplier#000000002') AS BIGINT) AS \"Supplier#000000002\" FROM points GROUP BY day")
def pivot(spark, sf_dir):
    names = ["Supplier#000000001", "Supplier#000000002"]
    return compare.pivoted(points(spark, sf_dir).where(F.col("name").isin(names)), names)


@query("wn_latest_of_day", "SELECT CAST(o_custkey % 40 AS BIGINT) AS day, o_orderkey AS seq FROM orders QUALIFY o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey % 40)")
def latest_of_day(spark, sf_dir):
    return compare.latest_of_day(Scan(spark, sf_dir).table("orders").select((F.col("o_custkey") % 40).alias("day"), F.col("o_orderkey").alias("seq")))


@query("st_names_union", f"WITH {SNAPS}, {CONFIG} SELECT name FROM snaps WHERE source = 'other' UNION SELECT name FROM cu")
def names_union(spark, sf_dir):
    """Names that a report counts as others, and configured ones."""
    others = fixtures.snapshots(spark, sf_dir).where("source = 'other'").select("name")
    return compare.names_of(others, Scan(spark, sf_dir).users)


@query("st_config_except", f"WITH {CONFIG} SELECT name, team_id FROM cu WHERE name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 7 = 1)")
def config_except(spark, sf_dir):
    s = Scan(spark, sf_dir)
    gone = s.table("supplier").where("s_suppkey % 7 = 1").select(F.col("s_name").alias("name"))
    return s.users.join(gone, "name", "left_anti")
