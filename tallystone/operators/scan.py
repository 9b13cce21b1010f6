"""Filters and deduplication of scanned entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, from_segments, parent_or_root, segments, under

#: Directory names that are never entered, and magic numbers of virtual file systems.
CRITICAL_NAMES = [".snapshot", ".snapshots", ".zfs", "proc", "sys", "dev", ".nfs"]
VIRTUAL_FS = [0x9FA0, 0x62656572, 0x64626720, 0x01021994, 0x1CD1, 0x42494E4D, 0x27E0EB, 0x63677270, 0x794C7630, 0x858458F6, 0x73636673, 0x67596969]


def outside(path: Column, skipped: list[str]) -> Column:
    """True for paths outside every skipped directory, by whole names."""
    keep = F.lit(True)
    for s in skipped:
        keep = keep & ~under(path, s)
    return keep


def drop_below(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """``rows`` (path, ...) without those at or below a directory of ``skipped`` (path), however many there are.

    Directories are few against files: the hit directories are found once per
    distinct parent, then one anti join removes the files.
    """
    gone = skipped.select(F.col("path").alias("gone"))
    dirs = rows.select(parent_or_root(F.col("path")).alias("dir")).distinct()
    hit = dirs.withColumn("up", F.explode(F.transform(ancestors(segments(F.col("dir"))), from_segments))).join(gone, F.col("up") == F.col("gone"), "left_semi").select("dir").distinct()
    rows = rows.join(gone, F.col("path") == F.col("gone"), "left_anti")
    return rows.join(hit, parent_or_root(rows["path"]) == hit["dir"], "left_anti")


def without_critical(rows: DataFrame, root: str = "/", names: list[str] | None = None) -> DataFrame:
    """Files in no directory of a critical name, the root's own name included, its ancestors' not."""
    above = F.lit(max(0, len([s for s in root.split("/") if s]) - 1))
    segs = segments(parent_or_root(F.col("path")))
    below = F.slice(segs, above + 1, F.greatest(F.lit(0), F.size(segs) - above))
    return rows.where(~F.arrays_overlap(below, F.array(*map(F.lit, names or CRITICAL_NAMES))))


def same_filesystem(rows: DataFrame, root_dev: int) -> DataFrame:
    """Entries of the root's device only."""
    return rows.where(F.col("dev") == root_dev)


def real_filesystem(rows: DataFrame) -> DataFrame:
    """Entries (f_type) on no virtual file system."""
    return rows.where(~F.col("f_type").isin(VIRTUAL_FS))


def one_per_inode(rows: DataFrame) -> DataFrame:
    """Every inode once, under its smallest path; ties are broken by uid, size and ``tie``.

    With a link count (nlink) only entries with several links pass the shuffle of
    the window, the others are taken as they are, also where the file system
    gives no count (0 or null). Without the column, every entry may have other links.
    """
    order = Window.partitionBy("ino", "dev").orderBy("path", "uid", "size", "tie")
    first = lambda df: df.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    if "nlink" not in rows.columns:
        return first(rows)
    return rows.where("nlink is null or nlink <= 1").unionByName(first(rows.where("nlink > 1")))


def met_again(dirs: DataFrame) -> DataFrame:
    """path of every second path to a directory. The first is the least deep, then the smallest by names."""
    names = segments(F.col("path"))
    order = Window.partitionBy("ino", "dev").orderBy(F.size(names), names)
    return dirs.withColumn("place", F.row_number().over(order)).where("place > 1").select("path")


def visited_once(dirs: DataFrame) -> DataFrame:
    """Directories without those below a second path to a directory that was met before."""
    return drop_below(dirs, met_again(dirs))


def entered_once(entries: DataFrame) -> DataFrame:
    """Entries without second paths to a directory and what those hold directly.

    A directory below a second path goes by its own inode: it stays if no other
    path to it was walked, as when a task of the walk met it there first.
    """
    gone = met_again(entries.where("kind = 'dir' and error is null")).select(F.col("path").alias("gone"))
    rows = entries.join(gone, F.col("path") == F.col("gone"), "left_anti")
    return rows.join(gone, (parent_or_root(rows["path"]) == F.col("gone")) & (rows["kind"] != "dir"), "left_anti")


def targeted(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """Entries of the given uids. Global counters are taken before this filter."""
    return rows.join(uids, "uid", "left_semi")


def counters(entries: DataFrame) -> DataFrame:
    """total_files, total_dirs, total_inodes, total_size of entries (kind: file, dir, symlink, other).

    Symbolic links count as inodes only, other kinds not at all.
    """
    count = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")), F.lit(0))
    return entries.agg(
        count("file").alias("total_files"),
        count("dir").alias("total_dirs"),
        count("file", "dir", "symlink").alias("total_inodes"),
        F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("total_size"),
    )
