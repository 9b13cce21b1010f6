"""What the registered queries share: the scan of the fixtures, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, facts, scan, tree
from ..sources import fixtures
from ..staging import staged


class Scan:
    """Tables of one scan, each built from the one before."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._files: DataFrame | None = None
        self._direct: DataFrame | None = None
        self._tree: DataFrame | None = None

    def stage(self) -> Scan:
        """For plans that use them several times: files, direct usage, and the tree built from it, are written once."""
        self._files = staged(self.files)
        self._direct = staged(tree.direct_usage(self._files))
        self._tree = staged(tree.numbered(tree.closure(self._direct)))
        return self

    def table(self, name: str) -> DataFrame:
        return fixtures.read(self.spark, self.sf_dir, name)

    @property
    def files(self) -> DataFrame:
        return self._files if self._files is not None else scan.one_per_inode(fixtures.inodes(self.spark, self.sf_dir)).select("path", "uid", "size")

    @property
    def direct(self) -> DataFrame:
        return tree.direct_usage(self.files) if self._direct is None else self._direct

    @property
    def tree(self) -> DataFrame:
        return tree.numbered(tree.closure(self.direct)) if self._tree is None else self._tree

    @property
    def usernames(self) -> DataFrame:
        return fixtures.usernames(self.spark, self.sf_dir)

    @property
    def users(self) -> DataFrame:
        return fixtures.configured_users(self.spark, self.sf_dir)

    @property
    def teams(self) -> DataFrame:
        return fixtures.teams(self.spark, self.sf_dir)

    @property
    def sizes(self) -> DataFrame:
        return self.files.groupBy("uid").agg(F.sum("size").alias("size"), F.count("*").alias("files"))

    @property
    def classified(self) -> DataFrame:
        return classify.classified(self.sizes, self.usernames, self.users, self.teams)

    @property
    def owners(self) -> DataFrame:
        """Owners of the directories that hold files; those whose smallest uid is odd are unknown."""
        seen = self.direct.groupBy(F.col("dir").alias("path")).agg(F.min("uid").alias("owner_uid")).where("owner_uid % 2 = 0")
        return facts.owners(self.tree, seen)


EV = """ev AS (
  SELECT '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/o' || CAST(l_orderkey % 7 AS VARCHAR) || '/l' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '.' || l_returnflag || l_linestatus AS path,
    l_suppkey AS uid, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_orderkey * 8 + l_linenumber AS ino, CAST(r_regionkey AS BIGINT) AS dev, l_partkey AS tie
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FE = EV + """, fe AS (
  SELECT path, uid, size FROM (SELECT *, row_number() OVER (PARTITION BY ino, dev ORDER BY path, uid, size, tie) AS place FROM ev) WHERE place = 1)"""
DD = FE + """, dd AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, uid, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM fe GROUP BY ALL)"""
UP = """up AS (
  SELECT DISTINCT dir, coalesce('/' || array_to_string(s[1:i], '/'), '/') AS path, s[1:i] AS segs
  FROM (SELECT DISTINCT dir, string_split(substr(dir, 2), '/') AS s FROM dd), LATERAL (SELECT unnest(generate_series(0, len(s))) AS i))"""
TREE = DD + ", " + UP + """, nodes AS (SELECT DISTINCT path, segs FROM up),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY len(segs), segs) - 1 AS BIGINT) AS dir_id, path, CAST(len(segs) AS INTEGER) AS depth, segs, CASE WHEN len(segs) = 0 THEN '/' ELSE segs[-1] END AS name FROM nodes),
names AS (SELECT name, CAST(row_number() OVER (ORDER BY min(dir_id)) - 1 AS BIGINT) AS name_id FROM numbered GROUP BY name),
tree AS (
  SELECT n.dir_id, p.dir_id AS parent_id, n.depth, n.path, n.name, name_id, n.segs
  FROM numbered n JOIN names USING (name) LEFT JOIN numbered p ON n.depth > 0 AND p.segs = n.segs[1:n.depth - 1])"""
ROOTED = (
    TREE.replace("SELECT DISTINCT path, segs FROM up)", "SELECT DISTINCT path, segs FROM up WHERE path = '/EUROPE' OR starts_with(path, '/EUROPE/'))")
    .replace("CAST(len(segs) AS INTEGER) AS depth", "CAST(len(segs) - 1 AS INTEGER) AS depth")
    .replace("p.segs = n.segs[1:n.depth - 1]", "p.segs = n.segs[1:n.depth]")
)
UN = "un AS (SELECT s_suppkey AS uid, s_name AS username FROM supplier WHERE s_suppkey % 10 <> 9)"
CONFIG = UN + """, cu AS (SELECT s_name AS name, CAST(s_nationkey % 5 AS VARCHAR) AS team_id FROM supplier WHERE s_suppkey % 5 <> 0),
tm AS (SELECT CAST(r_regionkey AS VARCHAR) AS team_id, r_name AS team FROM region WHERE r_regionkey < 4)"""
CLASSIFIED = FE + ", " + CONFIG + """, named AS (
  SELECT coalesce(username, 'uid-' || CAST(fe.uid AS VARCHAR)) AS username, CAST(sum(size) AS BIGINT) AS used, count(*) AS inodes FROM fe LEFT JOIN un ON fe.uid = un.uid GROUP BY 1),
cl AS (
  SELECT username, used, inodes, cu.name IS NOT NULL AS configured, cu.team_id AS team_id, CASE WHEN cu.name IS NOT NULL THEN coalesce(team, 'Other') END AS team
  FROM named LEFT JOIN cu ON username = cu.name LEFT JOIN tm ON cu.team_id = tm.team_id)"""
SUBTREE = "subtree AS (SELECT path, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(files) AS BIGINT) AS total_files FROM (SELECT dir, sum(size) AS size, sum(files) AS files FROM dd GROUP BY dir) JOIN up USING (dir) GROUP BY path)"
MINE = "mine AS (SELECT uid, path, CAST(sum(size) AS BIGINT) AS used FROM dd JOIN up USING (dir) WHERE EXISTS (SELECT 1 FROM dd o WHERE o.uid = dd.uid AND o.dir = up.path) GROUP BY uid, path)"
