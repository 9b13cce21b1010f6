"""From entries or events to the tables of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, issues, scan, tree
from ..staging import staged


def files_of(entries: DataFrame, target_uids: DataFrame | None = None) -> DataFrame:
    """path, uid, size of the files, each inode once. Global counters are taken from ``entries`` before."""
    files = scan.one_per_inode(entries.where("kind = 'file' and error is null").withColumn("tie", F.col("ino")))
    files = files.select("path", "uid", "size")
    return files if target_uids is None else scan.targeted(files, target_uids).select("path", "uid", "size")


def owners_of(entries: DataFrame) -> DataFrame:
    """path, owner_uid of directories."""
    return entries.where("kind = 'dir'").select("path", F.col("uid").alias("owner_uid"))


def issues_of(entries: DataFrame) -> DataFrame:
    """uid, kind, errcode, path of entries that could not be read."""
    return entries.where("error is not null").select("uid", "kind", F.col("error").alias("errcode"), "path")


def tables(files: DataFrame, usernames: DataFrame, users: DataFrame, owners: DataFrame, events: DataFrame, max_level: int = 3, root: str = "/", treemap: bool = True) -> dict[str, DataFrame]:
    """users, dirs, files, file_names, issues; with ``treemap`` also treemap, names, owners.

    Files (each inode once), direct usage and the tree from ``root`` on are written
    once each; all tables are made from those.
    """
    files = staged(files)
    direct = staged(tree.direct_usage(files))
    nodes = staged(tree.numbered(tree.closure(direct, root), root))
    rows = facts.file_rows(files, nodes)
    names = facts.dictionary(rows, "name", "name_id")
    out = {
        "users": facts.user_rows(direct, usernames, users),
        "dirs": facts.user_dir_rows(tree.positive(direct), nodes),
        "file_names": names.select(F.col("name_id").alias("id"), "name"),
        "files": rows.join(names, "name").select("dir_id", "name_id", "ext", "uid", "size"),
        "issues": issues.numbered(issues.owned(events, usernames)),
    }
    if treemap:
        seen = facts.owners(nodes, owners)
        shown = staged(tree.treemap(nodes, direct, seen, max_level, root))
        out |= {
            "treemap": shown,
            "names": nodes.join(shown.select("name_id"), "name_id", "left_semi").select(F.col("name_id").alias("id"), "name").distinct(),
            "owners": facts.named(shown.select(F.col("owner_uid").alias("uid")).distinct(), usernames),
        }
    return out
