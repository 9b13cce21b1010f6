"""The directory tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import clamp_depth, from_segments, parent_or_root
from ..operators import tree
from ..registry import query
from .base import MINE, ROOTED, SUBTREE, TREE, Scan

TREEMAP = TREE + f""", {SUBTREE}, own AS (SELECT dir AS path, sum(size) AS own_size, CAST(sum(files) AS BIGINT) AS own_files, min(uid) AS low FROM dd GROUP BY dir),
kids AS (SELECT parent_id AS dir_id, count(*) AS own_dirs FROM tree WHERE parent_id IS NOT NULL GROUP BY 1),
treemap AS (
  SELECT t.dir_id, t.parent_id, t.name_id, t.path, coalesce(total_size, 0) AS total_size, coalesce(own_files, 0) AS file_count, coalesce(own_dirs, 0) AS dir_count,
    coalesce(CASE WHEN low % 2 = 0 THEN low END, (SELECT min(uid) FROM dd)) AS owner_uid, CAST(coalesce(own_files, 0) > 0 OR coalesce(own_size, 0) > 0 AS INTEGER) AS has_files, t.depth
  FROM tree t LEFT JOIN subtree USING (path) LEFT JOIN own USING (path) LEFT JOIN kids USING (dir_id))"""


def views(source: str, start: str, level: int, limit: int, measure: str) -> str:
    """SQL of a tree view: a recursive walk over the ranked children."""
    top = len([s for s in start.split("/") if s])
    return f"""ranked AS (
  SELECT *, coalesce(nullif(regexp_replace(path, '/[^/]*$', ''), ''), '/') AS up,
    row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY {measure} DESC, path) AS place,
    greatest(0, count(*) OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '')) - {limit}) AS hidden
  FROM {source} WHERE path <> '/' AND starts_with(path, '{start.rstrip("/")}/')),
walk AS (
  SELECT path, {measure}, place, hidden, 1 AS depth FROM ranked WHERE up = '{start}' AND place <= {limit}
  UNION ALL SELECT r.path, r.{measure}, r.place, r.hidden, w.depth + 1 FROM walk w JOIN ranked r ON r.up = w.path WHERE r.place <= {limit} AND w.depth < {level})"""


@query("tr_closure", f"WITH {TREE} SELECT path, depth FROM tree")
def closure(spark, sf_dir):
    return tree.closure(Scan(spark, sf_dir).direct).select(from_segments(F.col("segs")).alias("path"), F.size("segs").alias("depth"))


@query("tr_numbered", f"WITH {TREE} SELECT dir_id, parent_id, depth, path, name, name_id FROM tree")
def numbered(spark, sf_dir):
    return Scan(spark, sf_dir).stage().tree.drop("segs")


@query("tr_rooted", f"WITH {ROOTED} SELECT dir_id, parent_id, depth, path, name, name_id FROM tree")
def rooted(spark, sf_dir):
    """The tree of a scan whose root is a directory below others."""
    return tree.numbered(tree.closure(Scan(spark, sf_dir).direct, "/EUROPE"), "/EUROPE").drop("segs")


@query("tr_rooted_subtree", f"WITH {ROOTED}, {SUBTREE} SELECT path, total_size, total_files FROM subtree JOIN tree USING (path)")
def rooted_subtree(spark, sf_dir):
    return tree.subtree_usage(Scan(spark, sf_dir).direct, "/EUROPE")


@query("tr_subtree", f"WITH {TREE}, {SUBTREE} SELECT path, total_size, total_files FROM subtree")
def subtree(spark, sf_dir):
    return tree.subtree_usage(Scan(spark, sf_dir).direct)


@query("tr_treemap", f"WITH {TREEMAP} SELECT * EXCLUDE (depth) FROM treemap")
def treemap(spark, sf_dir):
    s = Scan(spark, sf_dir).stage()
    return tree.treemap(s.tree, s.direct, s.owners)


@query("tr_treemap_levels", f"WITH {TREEMAP} SELECT * EXCLUDE (depth) FROM treemap WHERE depth <= 2")
def treemap_levels(spark, sf_dir):
    s = Scan(spark, sf_dir).stage()
    return tree.treemap(s.tree, s.direct, s.owners, 2)


@query("tr_rooted_treemap", f"WITH {TREEMAP.replace(TREE, ROOTED)} SELECT * EXCLUDE (depth) FROM treemap WHERE depth <= 1")
def rooted_treemap(spark, sf_dir):
    """Levels count from the scan root."""
    s = Scan(spark, sf_dir).stage()
    nodes = tree.numbered(tree.closure(s.direct, "/EUROPE"), "/EUROPE")
    return tree.treemap(nodes, s.direct, s.owners, 1, "/EUROPE")


@query("tr_user_rollup", f"""WITH {TREE.replace("regexp_replace(path, '/[^/]*$', '') AS dir", "CASE WHEN uid % 3 = 0 THEN regexp_replace(path, '/[^/]*/[^/]*$', '') ELSE regexp_replace(path, '/[^/]*$', '') END AS dir")}, {MINE} SELECT uid, path, used FROM mine""")
def user_rollup(spark, sf_dir):
    path = F.when(F.col("uid") % 3 == 0, parent_or_root(F.col("path"))).otherwise(F.col("path"))
    return tree.user_usage(tree.direct_usage(Scan(spark, sf_dir).files.withColumn("path", path)))


@query("tr_ancestor_set", f"WITH {TREE} SELECT DISTINCT u.path FROM up u WHERE u.dir LIKE '%/o3'")
def ancestor_set(spark, sf_dir):
    return tree.ancestor_set(Scan(spark, sf_dir).direct.where(F.endswith("dir", F.lit("/o3"))).select(F.col("dir").alias("path")))


@query("tr_descendants", f"WITH {TREE} SELECT dir_id, path FROM tree WHERE starts_with(path, '/ASIA/')")
def descendants(spark, sf_dir):
    return tree.descendants(Scan(spark, sf_dir).stage().tree, "/ASIA").select("dir_id", "path")


@query("tr_path_to_id", f"WITH {TREE} SELECT dir_id, path FROM tree WHERE path IN ('/', '/EUROPE', '/AFRICA/NATION_0')")
def path_to_id(spark, sf_dir):
    wanted = spark.createDataFrame([("",), ("/EUROPE/",), ("/AFRICA/NATION_0",), ("/nowhere",)], "path string")
    return tree.ids_of(Scan(spark, sf_dir).stage().tree, wanted)


@query("tr_clamped", f"WITH {TREE} SELECT '/' || array_to_string(string_split(substr(dir, 2), '/')[1:2], '/') AS path, CAST(sum(size) AS BIGINT) AS size FROM dd GROUP BY 1")
def clamped(spark, sf_dir):
    return Scan(spark, sf_dir).direct.groupBy(clamp_depth(F.col("dir"), 2).alias("path")).agg(F.sum("size").alias("size"))


@query("rq10_tree_view", f"WITH RECURSIVE {TREEMAP}, {views('treemap', '/', 3, 3, 'total_size')} SELECT path, depth, place, hidden, total_size FROM walk")
def tree_view(spark, sf_dir):
    s = Scan(spark, sf_dir)
    rows = tree.subtree_usage(s.direct, deepest=3).select("path", "total_size")
    return tree.view(rows, "/", 3, 3, "total_size").select("path", "depth", F.col("place").cast("long").alias("place"), F.col("hidden").cast("long").alias("hidden"), "total_size")


@query(
    "rq11_user_tree_view",
    f"WITH RECURSIVE {TREE}, whole AS (SELECT path, CAST(sum(size) AS BIGINT) AS used FROM dd JOIN up USING (dir) WHERE uid = 7 GROUP BY path HAVING sum(size) > 0), {views('whole', '/EUROPE', 2, 2, 'used')} SELECT path, depth, place, hidden, used FROM walk",
)
def user_tree_view(spark, sf_dir):
    mine = Scan(spark, sf_dir).direct.where("uid = 7")
    rows = tree.subtree_usage(mine, "/EUROPE", deepest=3).where("total_size > 0").select("path", F.col("total_size").alias("used"))
    return tree.view(rows, "/EUROPE", 2, 2, "used").select("path", "depth", F.col("place").cast("long").alias("place"), F.col("hidden").cast("long").alias("hidden"), "used")


@query("st_matches_and_ancestors", f"WITH {TREE} SELECT DISTINCT u.path FROM up u JOIN nodes n ON n.path = u.dir WHERE u.dir ILIKE '%nation_1%' UNION SELECT path FROM nodes WHERE path ILIKE '%nation_1%' UNION SELECT u.path FROM up u WHERE u.dir ILIKE '%nation_1%'")
def matches_and_ancestors(spark, sf_dir):
    hits = Scan(spark, sf_dir).stage().tree.where(F.col("path").ilike("%nation_1%")).select("path")
    return tree.ancestor_set(hits)


