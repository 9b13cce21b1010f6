"""Filters, deduplication, counters and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, issues, mounts, scan, tree
from ..registry import query
from ..sources import event_files, fixtures, permission_lines
from .base import DD, EV, FE, UN, Scan

LINES = """lines AS (
  SELECT CASE WHEN event_id % 23 = 0 THEN 'P' || chr(9) || kind WHEN event_id % 29 = 0 THEN 'X' || line ELSE line END AS value FROM (
    SELECT event_id, kind, 'P' || chr(9) || CASE WHEN event_id % 19 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END || chr(9) || kind || chr(9) ||
      CASE event_id % 4 WHEN 0 THEN 'EACCES' WHEN 1 THEN 'ENOENT' WHEN 2 THEN 'EIO' ELSE 'EOTHER' END || chr(9) || '/u' || CAST(user_id % 17 AS VARCHAR) || '/e' || chr(9) || CAST(event_id AS VARCHAR) AS line
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'directory' ELSE 'file' END AS kind FROM events WHERE event_type = 'error'))),
perm AS (
  SELECT CAST(p[2] AS BIGINT) AS uid, p[3] AS kind, p[4] AS errcode, array_to_string(p[5:], chr(9)) AS path
  FROM (SELECT string_split(value, chr(9)) AS p FROM lines) WHERE len(p) >= 5 AND p[1] = 'P')"""
ISSUES = LINES + ", " + UN + """, iss AS (
  SELECT row_number() OVER (ORDER BY perm.uid, path, errcode, kind) AS id, coalesce(username, CASE WHEN perm.uid = 0 THEN '__unknown__' ELSE 'uid-' || CAST(perm.uid AS VARCHAR) END) AS user, kind AS item_type, errcode AS error, path
  FROM perm LEFT JOIN un ON perm.uid = un.uid AND un.uid <> 0)"""


def issue_rows(spark, sf_dir):
    events = permission_lines.parse(fixtures.issue_lines(spark, sf_dir))
    return issues.numbered(issues.owned(events, fixtures.usernames(spark, sf_dir).where("uid <> 0")))


@query("src_events", f"WITH {EV} SELECT path, uid, size, ino, dev FROM ev")
def events(spark, sf_dir):
    return fixtures.inodes(spark, sf_dir).select("path", "uid", "size", "ino", "dev")


@query("src_event_files", f"WITH {EV} SELECT path, uid, size FROM ev")
def event_payloads(spark, sf_dir):
    """Written as binary event files and read again."""
    rows = fixtures.inodes(spark, sf_dir).select("uid", "size", "path")
    return event_files.parsed(event_files.payloads(rows)).select("path", "uid", "size")


@query("src_owner_files", f"WITH {EV} SELECT path, uid FROM ev")
def owner_payloads(spark, sf_dir):
    rows = fixtures.inodes(spark, sf_dir).select("uid", "path")
    return event_files.parsed(event_files.payloads(rows, "dirowner_t"), "dirowner_t").select("path", "uid")


@query("src_directory_files", f"WITH {DD} SELECT uid, -size AS size, dir AS path FROM dd")
def directory_payloads(spark, sf_dir):
    """Directory sums may be corrections below zero."""
    rows = Scan(spark, sf_dir).direct.select("uid", (-F.col("size")).alias("size"), F.col("dir").alias("path"))
    return event_files.parsed(event_files.payloads(rows, "diragg_t"), "diragg_t")


@query("src_permission_lines", f"WITH {LINES} SELECT uid, kind, errcode, path FROM perm")
def permission_events(spark, sf_dir):
    return permission_lines.parse(fixtures.issue_lines(spark, sf_dir))


@query("src_known_users", f"WITH {UN} SELECT username FROM un")
def known_users(spark, sf_dir):
    return fixtures.usernames(spark, sf_dir).select("username")


@query("src_target_uids", f"WITH {UN} SELECT un.uid, username FROM un WHERE username IN ('Supplier#000000001', 'Supplier#000000003', 'nobody')")
def target_uids(spark, sf_dir):
    wanted = spark.createDataFrame([("Supplier#000000001",), ("Supplier#000000003",), ("nobody",)], "username string")
    return fixtures.usernames(spark, sf_dir).join(wanted, "username", "left_semi").select("uid", "username")


@query("flt_skip_dirs", f"WITH {EV} SELECT path, uid, size FROM ev WHERE NOT (path = '/ASIA' OR starts_with(path, '/ASIA/') OR path = '/EUROPE/NATION_3' OR starts_with(path, '/EUROPE/NATION_3/') OR starts_with(path, '/AFR/'))")
def skip_dirs(spark, sf_dir):
    return fixtures.inodes(spark, sf_dir).where(scan.outside(F.col("path"), ["/ASIA", "/EUROPE/NATION_3", "/AFR"])).select("path", "uid", "size")


@query("flt_skip_many", f"WITH {EV} SELECT path, uid, size FROM ev WHERE regexp_replace(path, '^/[^/]*/([^/]*)/.*$', '\\1') NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)")
def skip_many(spark, sf_dir):
    s = Scan(spark, sf_dir)
    gone = s.table("nation").where("n_nationkey % 3 = 0").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    return scan.drop_below(fixtures.inodes(spark, sf_dir).select("path", "uid", "size"), gone)


@query("flt_critical_names", f"WITH {EV}, c AS (SELECT CASE WHEN ino % 5 = 0 THEN replace(path, '/o', '/.snapshot/o') WHEN ino % 7 = 0 THEN regexp_replace(path, '[^/]*$', 'proc') ELSE path END AS path, uid, size FROM ev) SELECT path, uid, size FROM c WHERE NOT contains(path, '/.snapshot/')")
def critical_names(spark, sf_dir):
    path = F.when(F.col("ino") % 5 == 0, F.replace("path", F.lit("/o"), F.lit("/.snapshot/o"))).when(F.col("ino") % 7 == 0, F.regexp_replace("path", "[^/]+$", "proc")).otherwise(F.col("path"))
    return scan.without_critical(fixtures.inodes(spark, sf_dir).select(path.alias("path"), "uid", "size"))


@query("flt_device", f"WITH {EV} SELECT path, uid, size FROM ev WHERE dev = 2")
def device(spark, sf_dir):
    return scan.same_filesystem(fixtures.inodes(spark, sf_dir), 2).select("path", "uid", "size")


@query("flt_virtual_fs", f"WITH {EV} SELECT path, uid, size FROM ev WHERE dev NOT IN (1, 3)")
def virtual_fs(spark, sf_dir):
    kind = F.when(F.col("dev") == 1, 0x9FA0).when(F.col("dev") == 3, 0x01021994).otherwise(0x58465342)
    return scan.real_filesystem(fixtures.inodes(spark, sf_dir).withColumn("f_type", kind)).select("path", "uid", "size")


@query("flt_target_uids", f"WITH {FE}, {UN} SELECT path, uid, size FROM fe WHERE uid IN (SELECT uid FROM un WHERE uid % 4 = 1)")
def target_rows(spark, sf_dir):
    return scan.targeted(Scan(spark, sf_dir).files, fixtures.usernames(spark, sf_dir).where("uid % 4 = 1").select("uid")).select("path", "uid", "size")


@query("flt_keyword_like", f"WITH {FE} SELECT path, size FROM fe WHERE path ILIKE '%o_/L1%.rf%'")
def keyword_like(spark, sf_dir):
    return Scan(spark, sf_dir).files.where(F.col("path").ilike("%o_/L1%.rf%")).select("path", "size")


@query("flt_positive_sizes", f"WITH {DD} SELECT dir, uid, size FROM dd WHERE size > 0")
def positive_sizes(spark, sf_dir):
    return tree.positive(Scan(spark, sf_dir).direct).select("dir", "uid", "size")


@query("dd_hardlinks", f"WITH {FE} SELECT path, uid, size FROM fe")
def hardlinks(spark, sf_dir):
    return Scan(spark, sf_dir).files


@query("dd_hardlinks_counted", f"WITH {FE} SELECT path, uid, size FROM fe")
def hardlinks_counted(spark, sf_dir):
    """The same where entries know how many links they have: only linked ones are shuffled."""
    return scan.one_per_inode(fixtures.with_link_count(fixtures.inodes(spark, sf_dir))).select("path", "uid", "size")


@query("ag_counters", f"""WITH {EV}, e AS (SELECT CASE ino % 11 WHEN 0 THEN 'symlink' WHEN 1 THEN 'dir' WHEN 2 THEN 'other' ELSE 'file' END AS kind, size FROM ev)
SELECT count(*) FILTER (kind = 'file') AS total_files, count(*) FILTER (kind = 'dir') AS total_dirs, count(*) FILTER (kind <> 'other') AS total_inodes, CAST(sum(size) FILTER (kind = 'file') AS BIGINT) AS total_size FROM e""")
def counters(spark, sf_dir):
    pick = F.col("ino") % 11
    kind = F.when(pick == 0, "symlink").when(pick == 1, "dir").when(pick == 2, "other").otherwise("file")
    return scan.counters(fixtures.inodes(spark, sf_dir).withColumn("kind", kind))


@query("ag_uid_totals", f"WITH {FE} SELECT uid, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM fe GROUP BY uid")
def uid_totals(spark, sf_dir):
    return Scan(spark, sf_dir).sizes


@query("ag_user_dirs", f"WITH {DD} SELECT dir, uid, size, files FROM dd")
def user_dirs(spark, sf_dir):
    return Scan(spark, sf_dir).direct


@query("jn_names", f"WITH {FE}, {UN} SELECT path, coalesce(username, 'uid-' || CAST(fe.uid AS VARCHAR)) AS username, size FROM fe LEFT JOIN un ON fe.uid = un.uid")
def names(spark, sf_dir):
    return facts.named(Scan(spark, sf_dir).files, fixtures.usernames(spark, sf_dir)).select("path", "username", "size")


@query("dd_interned_users", f"""WITH {FE}, {UN}, n AS (SELECT DISTINCT coalesce(username, 'uid-' || CAST(fe.uid AS VARCHAR)) AS username FROM fe LEFT JOIN un ON fe.uid = un.uid)
SELECT username, coalesce(uid, 1000000000 + row_number() OVER (PARTITION BY uid IS NULL ORDER BY username) - 1) AS uid FROM n LEFT JOIN un USING (username)""")
def interned_users(spark, sf_dir):
    named = facts.named(Scan(spark, sf_dir).sizes, fixtures.usernames(spark, sf_dir))
    return facts.interned(named, fixtures.usernames(spark, sf_dir))


@query("iss_numbered", f"WITH {ISSUES} SELECT id, user, item_type, error, path FROM iss")
def numbered_issues(spark, sf_dir):
    return issue_rows(spark, sf_dir)


@query("iss_grouped", f"WITH {ISSUES}, f AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY path, error, item_type) AS place, count(*) OVER (PARTITION BY user) AS n FROM iss) SELECT user, n AS count, path, item_type, error FROM f WHERE place <= 3")
def grouped_issues(spark, sf_dir):
    found = issues.grouped(issue_rows(spark, sf_dir), 3)
    return found.select("user", "count", F.explode("inaccessible_items").alias("i")).select("user", "count", "i.path", F.col("i.type").alias("item_type"), "i.error")


@query("iss_by_user", f"WITH {ISSUES} SELECT user, count(*) AS issues, count(*) FILTER (item_type = 'directory') AS directories, count(*) FILTER (item_type <> 'directory') AS files FROM iss GROUP BY user")
def issues_by_user(spark, sf_dir):
    return issues.by_user(issue_rows(spark, sf_dir))


@query("rq9_user_issues", f"WITH {ISSUES} SELECT id, item_type, error, path, count(*) OVER () AS total FROM iss WHERE user = '__unknown__' AND path ILIKE '%/U1%' ORDER BY id LIMIT 15")
def user_issues(spark, sf_dir):
    return issues.of_user(issue_rows(spark, sf_dir), "__unknown__", 15, "/U1")


@query(
    "flt_duplicate_mounts",
    """WITH m AS (SELECT s_suppkey AS n, s_nationkey AS device, s_suppkey % 3 AS fs, CASE WHEN s_suppkey % 4 = 0 THEN '/other/m' ELSE '/data/m' END || CAST(s_suppkey AS VARCHAR) AS mount_point FROM supplier WHERE s_suppkey % 13 <> 0),
f AS (SELECT *, row_number() OVER w AS place, first_value(starts_with(mount_point, '/data/')) OVER w AS first_inside FROM m WINDOW w AS (PARTITION BY device, fs ORDER BY n))
SELECT mount_point FROM f WHERE place > 1 AND first_inside AND starts_with(mount_point, '/data/')""",
)
def duplicate_mounts(spark, sf_dir):
    """A mount table with a line for each supplier, some cut short."""
    key = F.col("s_suppkey").cast("string")
    point = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "/other/m").otherwise("/data/m"), key)
    line = F.concat_ws(" ", key, F.lit("1"), F.concat(F.lit("8:"), "s_nationkey"), F.concat(F.lit("/r"), F.col("s_suppkey") % 3), point, F.lit("rw"))
    lines = Scan(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("line_no"), F.when(F.col("s_suppkey") % 13 == 0, F.concat(key, F.lit(" x"))).otherwise(line).alias("value"))
    return mounts.duplicate_mounts(lines, "/data/")


@query("flt_bind_roots", "SELECT CAST(n_regionkey AS BIGINT) AS dev, CAST(n_nationkey % 4 AS BIGINT) AS ino FROM nation GROUP BY 1, 2 HAVING count(*) > 1")
def bind_roots(spark, sf_dir):
    return mounts.seen_twice(Scan(spark, sf_dir).table("nation").select(F.col("n_regionkey").cast("long").alias("dev"), (F.col("n_nationkey") % 4).cast("long").alias("ino")))
