"""The directory tree: closure, numbering, rollups and views.

A directory is its list of names; ``/`` has none. The tree of a scan begins at its
root, which has number 0 and depth 0, whatever stands above it. Rollups explode a
directory's ancestors after sizes are summed per (directory, uid), so the factor
is directories x depth, whatever the number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, clamp_depth, from_segments, levels, parent_or_root, segments, under
from .numbering import numbered_by


def direct_usage(files: DataFrame) -> DataFrame:
    """dir, uid, size, files of every (directory, uid) with files."""
    return files.groupBy(parent_or_root(F.col("path")).alias("dir"), "uid").agg(F.sum("size").alias("size"), F.count("*").alias("files"))


def positive(direct: DataFrame) -> DataFrame:
    """The (directory, uid) rows that hold any bytes."""
    return direct.where("size > 0")


def directory_usage(direct: DataFrame) -> DataFrame:
    """dir, files, size of every directory, all users together, nothing below it."""
    return direct.groupBy("dir").agg(F.sum("files").alias("files"), F.sum("size").alias("size"))


def largest_owners(direct: DataFrame) -> DataFrame:
    """dir, uid: who holds most of a directory's own bytes, of equals the smallest uid."""
    return direct.groupBy("dir").agg(F.max_by("uid", F.struct("size", -F.col("uid"))).alias("uid"))


def steps(path, root: str = "/"):
    """The paths of the root, of the directories on the way down from it, and the path itself."""
    return F.transform(ancestors(segments(path), levels(root)), from_segments)


def closure(dirs: DataFrame, root: str = "/") -> DataFrame:
    """segs of the root, of every directory of ``dirs`` (dir) below it and of all its ancestors down from the root."""
    inside = dirs.select("dir").where(under(F.col("dir"), root)).distinct()
    whole = inside.unionByName(dirs.sparkSession.range(1).select(F.lit(root).alias("dir")))
    return whole.select(F.explode(ancestors(segments(F.col("dir")), levels(root))).alias("segs")).distinct()


def numbered(segs: DataFrame, root: str = "/") -> DataFrame:
    """dir_id, path, depth, parent_id, name, name_id, segs: breadth-first numbers, siblings by path.

    The order is (depth, names); depth counts from the root. The root's name is its
    last one, ``/`` if it has none.
    """
    rows = segs.select("segs", (F.size("segs") - levels(root)).alias("depth"))
    tree = numbered_by(rows, "dir_id", "depth", "segs").withColumn("path", from_segments(F.col("segs")))
    tree = tree.withColumn("name", F.when(F.size("segs") == 0, F.lit("/")).otherwise(F.try_element_at("segs", F.lit(-1))))
    up = tree.select(F.col("path").alias("up_path"), F.col("dir_id").alias("parent_id"))
    tree = tree.withColumn("up", F.when(F.col("depth") > 0, parent_or_root(F.col("path"))))
    tree = tree.join(up, F.col("up") == F.col("up_path"), "left")
    return tree.join(numbered_names(tree), "name").select("dir_id", "parent_id", "depth", "path", "name", "name_id", "segs")


def numbered_names(tree: DataFrame) -> DataFrame:
    """name, name_id: distinct names, numbered by first appearance."""
    first = tree.groupBy("name").agg(F.min("dir_id").alias("first"))
    return numbered_by(first, "name_id", "first").select("name", "name_id")


def child_counts(tree: DataFrame) -> DataFrame:
    """parent_id, dirs: how many directories stand directly in one that holds any."""
    return tree.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("dirs"))


def ids_of(tree: DataFrame, paths: DataFrame, root: str = "/") -> DataFrame:
    """dir_id, path of the given paths (path) that are in the tree. Trailing slashes do not count; empty is the root."""
    bare = F.regexp_replace("path", "/+$", "")
    wanted = paths.select(F.when(bare == "", F.lit(root)).otherwise(bare).alias("path"))
    return tree.join(wanted, "path", "left_semi").select("dir_id", "path")


def subtree_usage(direct: DataFrame, root: str = "/", deepest: int | None = None) -> DataFrame:
    """path, total_size, total_files of every directory from the root on with everything below it. ``direct``: dir, size, files.

    With ``deepest`` only directories of at most so many names are told; what lies
    below is added to those first, so it is not spread over its ancestors.
    """
    own = direct if root == "/" else direct.where(under(F.col("dir"), root))
    where = F.col("dir") if deepest is None else clamp_depth(F.col("dir"), max(deepest, levels(root)))
    own = own.groupBy(where.alias("dir")).agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    spread = own.select(F.explode(steps(F.col("dir"), root)).alias("path"), "size", "files")
    return spread.groupBy("path").agg(F.sum("size").alias("total_size"), F.sum("files").alias("total_files"))


def user_usage(direct: DataFrame) -> DataFrame:
    """uid, path, used: each user's size in a directory and below, for directories in which the user has files."""
    spread = direct.select("uid", F.explode(F.transform(ancestors(segments(F.col("dir"))), from_segments)).alias("path"), "size")
    mine = direct.select("uid", F.col("dir").alias("path"))
    return spread.join(mine, ["uid", "path"], "left_semi").groupBy("uid", "path").agg(F.sum("size").alias("used"))


def ancestor_set(paths: DataFrame) -> DataFrame:
    """path of all the given paths and their ancestors."""
    return paths.select(F.explode(F.transform(ancestors(segments(F.col("path"))), from_segments)).alias("path")).distinct()


def descendants(tree: DataFrame, start: str) -> DataFrame:
    """Rows strictly below ``start``."""
    return tree.where(F.col("path") != "/") if start == "/" else tree.where(F.startswith("path", F.lit(start + "/")))


def treemap(tree: DataFrame, direct: DataFrame, owners: DataFrame, max_level: int = 0, root: str = "/") -> DataFrame:
    """dir_id, parent_id, name_id, path, total_size (subtree), file_count and dir_count (direct), owner_uid, has_files.

    ``owners``: path, owner_uid; where unknown, the smallest known uid of owners
    and usage. ``max_level`` 0: all levels; the root stays in any case. Levels count
    from the root. What files stand outside the root is told by no directory.
    """
    own = direct.groupBy(F.col("dir").alias("path")).agg(F.sum("size").alias("own_size"), F.sum("files").alias("own_files"))
    children = child_counts(tree).select(F.col("parent_id").alias("dir_id"), F.col("dirs").alias("own_dirs"))
    known = owners.select("owner_uid").unionByName(direct.select(F.col("uid").alias("owner_uid"))).agg(F.min("owner_uid").alias("any_uid"))
    rows = tree if max_level == 0 else tree.where((F.col("depth") <= max_level) | (F.col("depth") == 0))
    sums = subtree_usage(direct, root, levels(root) + max_level if max_level else None)
    rows = rows.join(sums, "path", "left").join(own, "path", "left").join(children, "dir_id", "left").join(owners, "path", "left").join(F.broadcast(known))
    zero = F.lit(0).cast("long")
    return rows.select(
        "dir_id",
        "parent_id",
        "name_id",
        "path",
        F.coalesce("total_size", zero).alias("total_size"),
        F.coalesce("own_files", zero).alias("file_count"),
        F.coalesce("own_dirs", zero).alias("dir_count"),
        F.coalesce("owner_uid", "any_uid").alias("owner_uid"),
        F.when((F.coalesce("own_files", zero) > 0) | (F.coalesce("own_size", zero) > 0), 1).otherwise(0).alias("has_files"),
    )


def view(rows: DataFrame, start: str, level: int, limit: int, measure: str) -> DataFrame:
    """The rows (path, ``measure``, ...) that a tree view from ``start`` shows, with depth, place and hidden.

    Children are ranked once by ``measure``; a row shows if it and all its
    ancestors below the start rank within ``limit``, at most ``level`` deep.
    ``hidden``: children beyond the limit next to it.
    """
    deep = F.size(segments(F.col("path"))) - levels(start)
    inside = descendants(rows, start).withColumn("depth", deep).where(F.col("depth") <= level).withColumn("up", parent_or_root(F.col("path")))
    order = Window.partitionBy("up").orderBy(F.desc(measure), "path")
    kept = inside.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    more = inside.groupBy("up").agg(F.count("*").alias("n")).select("up", F.greatest(F.lit(0), F.col("n") - limit).alias("hidden"))
    kept = kept.join(more, "up")
    chain = kept.select("path", F.explode(F.transform(ancestors(segments(F.col("path"))), from_segments)).alias("step"), "depth")
    whole = chain.join(kept.select(F.col("path").alias("step")), "step", "left_semi").groupBy("path", "depth").agg(F.count("*").alias("steps")).where("steps = depth")
    return kept.join(whole.select("path"), "path", "left_semi").drop("up")
