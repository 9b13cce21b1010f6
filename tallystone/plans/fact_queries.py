"""Fact tables and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import basename, parent_or_root
from ..operators import classify, facts, mounts, tree
from ..registry import query
from ..sources import fixtures
from .base import CONFIG, DD, EV, FE, TREE, UN, Scan
from .tree_queries import TREEMAP


@query("fact_files", f"WITH {TREE} SELECT coalesce(dir_id, 0) AS dir_id, string_split(fe.path, '/')[-1] AS name, lower(regexp_extract(fe.path, '\\.([^./]*)$', 1)) AS ext, uid, size FROM fe LEFT JOIN tree ON tree.path = regexp_replace(fe.path, '/[^/]*$', '')")
def fact_files(spark, sf_dir):
    s = Scan(spark, sf_dir).stage()
    return facts.file_rows(s.files, s.tree)


@query("fact_files_outside", f"WITH {TREE} SELECT CASE WHEN uid % 4 = 0 THEN 0 ELSE dir_id END AS dir_id, uid, CAST(sum(size) AS BIGINT) AS size FROM fe JOIN tree ON tree.path = regexp_replace(fe.path, '/[^/]*$', '') GROUP BY ALL")
def fact_files_outside(spark, sf_dir):
    """Files outside the tree belong to the root."""
    s = Scan(spark, sf_dir).stage()
    moved = s.files.withColumn("path", F.when(F.col("uid") % 4 == 0, F.concat(F.lit("/elsewhere"), "path")).otherwise(F.col("path")))
    return facts.file_rows(moved, s.tree).groupBy("dir_id", "uid").agg(F.sum("size").alias("size"))


@query("fact_names", f"WITH {FE} SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS name_id FROM (SELECT DISTINCT string_split(path, '/')[-1] AS name FROM fe)")
def fact_names(spark, sf_dir):
    return facts.dictionary(Scan(spark, sf_dir).files.select(basename(F.col("path")).alias("name")), "name", "name_id")


@query("fact_extensions", f"WITH {FE} SELECT lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM fe GROUP BY 1")
def fact_extensions(spark, sf_dir):
    return facts.extension_rows(Scan(spark, sf_dir).files)


@query("fact_users", f"""WITH {DD}, {CONFIG}
SELECT dd.uid, coalesce(username, 'uid-' || CAST(dd.uid AS VARCHAR)) AS username, coalesce(team_id, '') AS team_id, CAST(sum(files) AS BIGINT) AS total_files, count(*) FILTER (size > 0) AS total_dirs, CAST(sum(size) AS BIGINT) AS total_size
FROM dd LEFT JOIN un ON dd.uid = un.uid LEFT JOIN cu ON cu.name = username GROUP BY 1, 2, 3""")
def fact_users(spark, sf_dir):
    s = Scan(spark, sf_dir)
    return facts.user_rows(s.direct, s.usernames, s.users)


@query("fact_user_dirs", f"WITH {TREE} SELECT dir_id, uid, parent_id, dd.dir AS path, size, files FROM dd LEFT JOIN tree ON tree.path = dd.dir")
def fact_user_dirs(spark, sf_dir):
    s = Scan(spark, sf_dir).stage()
    return facts.user_dir_rows(s.direct, s.tree)


@query("fact_dir_files", f"WITH {DD} SELECT dir, CAST(sum(files) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS size FROM dd GROUP BY dir")
def fact_dir_files(spark, sf_dir):
    return tree.directory_usage(Scan(spark, sf_dir).direct)


@query("fact_child_dirs", f"WITH {TREE} SELECT parent_id, count(*) AS dirs FROM tree WHERE parent_id IS NOT NULL GROUP BY 1")
def fact_child_dirs(spark, sf_dir):
    return tree.child_counts(Scan(spark, sf_dir).stage().tree)


@query("fact_owners", f"WITH {TREEMAP} SELECT path, owner_uid FROM treemap WHERE path IN (SELECT dir FROM dd GROUP BY dir HAVING min(uid) % 2 = 0)")
def fact_owners(spark, sf_dir):
    return Scan(spark, sf_dir).stage().owners


@query("fact_largest_owner", f"WITH {DD} SELECT dir, uid FROM (SELECT dir, uid, row_number() OVER (PARTITION BY dir ORDER BY size DESC, uid) AS place FROM dd) WHERE place = 1")
def largest_owner(spark, sf_dir):
    return tree.largest_owners(Scan(spark, sf_dir).direct)


@query("fact_meta", f"""WITH {TREE}, t AS (SELECT CAST(count(*) AS VARCHAR) AS files, CAST(sum(size) AS VARCHAR) AS size FROM fe), d AS (SELECT CAST(count(*) AS VARCHAR) AS dirs FROM tree)
SELECT 'scan_root' AS key, '/' AS value UNION ALL SELECT 'schema_version', '1' UNION ALL SELECT 'total_files', files FROM t UNION ALL SELECT 'total_size', size FROM t UNION ALL SELECT 'total_dirs', dirs FROM d""")
def fact_meta(spark, sf_dir):
    s = Scan(spark, sf_dir).stage()
    fixed = facts.meta_rows({"scan_root": "/", "schema_version": "1"}, spark)
    text = lambda c: F.col(c).cast("string")
    sums = s.files.agg(F.count("*").alias("n"), F.sum("size").alias("z")).select(F.explode(F.create_map(F.lit("total_files"), text("n"), F.lit("total_size"), text("z"))))
    dirs = s.tree.agg(F.count("*").alias("n")).select(F.lit("total_dirs").alias("key"), text("n").alias("value"))
    return fixed.unionByName(sums).unionByName(dirs)


@query("fact_meta_upsert", "SELECT n_name[1] AS key, max_by(n_name, n_nationkey) AS value FROM nation GROUP BY 1")
def meta_upsert(spark, sf_dir):
    return facts.last_of_key(Scan(spark, sf_dir).table("nation").select(F.substring("n_name", 1, 1).alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq")))


@query("fact_meta_values", "SELECT key, coalesce(value, '') AS value FROM (SELECT DISTINCT r_name[1:1] AS key FROM region UNION SELECT DISTINCT 'x' || r_name[1:1] FROM region) LEFT JOIN (SELECT r_name[1] AS key, max_by(r_name, r_regionkey) AS value FROM region GROUP BY 1) USING (key)")
def meta_values(spark, sf_dir):
    """Keys that are there and keys that are not."""
    region = Scan(spark, sf_dir).table("region")
    first = F.substring("r_name", 1, 1)
    meta = facts.last_of_key(region.select(first.alias("key"), F.col("r_name").alias("value"), F.col("r_regionkey").alias("seq")))
    return facts.meta_values(meta, region.select(F.explode(F.array(first, F.concat(F.lit("x"), first))).alias("key")))


@query("st_uid_union", f"WITH {FE}, {UN} SELECT uid FROM fe UNION SELECT uid FROM un")
def uid_union(spark, sf_dir):
    s = Scan(spark, sf_dir)
    return facts.owner_uids(s.files, s.usernames)


@query("ag_owner_weights", f"WITH {TREE} SELECT dir_id, uid, size AS weight FROM dd JOIN tree ON tree.path = dd.dir WHERE size > 0")
def owner_weights(spark, sf_dir):
    """Parts as several writers leave them: one for each last digit of the size."""
    s = Scan(spark, sf_dir).stage()
    parts = s.files.groupBy(parent_or_root(F.col("path")).alias("dir"), "uid", (F.col("size") % 10).alias("part")).agg(F.sum("size").alias("size"))
    return facts.owner_weights(parts, s.tree)


@query("ag_team_counts", f"WITH {CONFIG} SELECT team, count(name) AS users FROM tm LEFT JOIN cu USING (team_id) GROUP BY team")
def team_counts(spark, sf_dir):
    s = Scan(spark, sf_dir)
    return classify.team_counts(s.users, s.teams)


@query("src_user_count", f"WITH {DD} SELECT count(DISTINCT uid) AS rows FROM dd")
def user_count(spark, sf_dir):
    s = Scan(spark, sf_dir)
    return facts.row_count(facts.user_rows(s.direct, s.usernames, s.users))


@query("dd_foreign_mounts", f"WITH {EV} SELECT dev, min(path) AS path FROM ev WHERE dev <> 2 GROUP BY dev")
def foreign_mounts(spark, sf_dir):
    return mounts.foreign(fixtures.inodes(spark, sf_dir), 2)
