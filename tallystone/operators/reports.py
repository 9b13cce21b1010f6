"""Report queries over the fact tables. Every limit has a complete order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, extension
from .facts import named
from .tree import descendants, user_usage


def top_usage(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("used"), "name").limit(limit)


def standard_report(rows: DataFrame, names: list[str] | None = None, limit: int = 10) -> DataFrame:
    """section, name, used: top users and top others, and only then the names asked for."""
    out = top_usage(rows.where("section = 'user'"), limit).unionByName(top_usage(rows.where("section = 'other'"), limit))
    return out if names is None else out.where(F.col("name").isin(names))


def checked_users(rows: DataFrame, names: list[str], total: int) -> DataFrame:
    """name, used, percent of the named users."""
    return rows.where(F.col("name").isin(names)).select("name", "used", (F.col("used").cast("double") / float(total or 1) * 100).alias("percent")).orderBy(F.desc("used"), "name")


def user_dirs(direct: DataFrame, uid: int, top: int | None, keyword: str = "") -> DataFrame:
    """path, used of the user's largest directories with what is below; a keyword is part of the path in any case and lifts the limit."""
    rows = user_usage(direct.where(F.col("uid") == uid)).select("path", "used")
    if keyword:
        return rows.where(F.contains(F.lower("path"), F.lit(keyword.lower()))).orderBy(F.desc("used"), "path")
    rows = rows.orderBy(F.desc("used"), "path")
    return rows if top is None else rows.limit(top)


def user_files(files: DataFrame, uid: int, top: int, keyword: str = "") -> DataFrame:
    """path, size of the user's largest files; a keyword is part of the file name in any case."""
    rows = files.where(F.col("uid") == uid)
    if keyword:
        rows = rows.where(F.contains(F.lower(basename(F.col("path"))), F.lit(keyword.lower())))
    return rows.select("path", "size").orderBy(F.desc("size"), "path").limit(top)


def files_page(files: DataFrame, uid: int, size: int, after: tuple[int, str] | None = None, ext: str | None = None) -> DataFrame:
    """path, size: one page in (size DESC, path) order after the last row of the page before."""
    rows = files.where(F.col("uid") == uid)
    if ext is not None:
        rows = rows.where(extension(F.col("path")) == ext)
    if after is not None:
        rows = rows.where((F.col("size") < after[0]) | ((F.col("size") == after[0]) & (F.col("path") > after[1])))
    return rows.select("path", "size").orderBy(F.desc("size"), "path").limit(size)


def dirs_page(dirs: DataFrame, uid: int, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """dir_id, path, size: one page of a user's directories in (size DESC, dir_id) order."""
    rows = dirs.where(F.col("uid") == uid)
    if after is not None:
        rows = rows.where((F.col("size") < after[0]) | ((F.col("size") == after[0]) & (F.col("dir_id") > after[1])))
    return rows.select("dir_id", "path", "size").orderBy(F.desc("size"), "dir_id").limit(size)


def user_inodes(direct: DataFrame, uid: int, top: int, pattern: str = "") -> DataFrame:
    """path, files: the user's directories with most files; ``pattern`` as in LIKE, % and _ not escaped."""
    rows = direct.where(F.col("uid") == uid)
    if pattern:
        rows = rows.where(F.col("dir").ilike(f"%{pattern}%"))
    return rows.select(F.col("dir").alias("path"), "files").orderBy(F.desc("files"), "path").limit(top)


def flat_search(tree: DataFrame, pattern: str, start: str, top: int) -> DataFrame:
    """path, total_size, matches: directories below ``start`` whose own name fits, and how many there are in all."""
    hits = descendants(tree, start).where(F.substring_index("path", "/", -1).ilike(f"%{pattern}%"))
    count = hits.agg(F.count("*").alias("matches"))
    return hits.select("path", "total_size").orderBy(F.desc("total_size"), "path").limit(top).join(F.broadcast(count))


def flat_user_search(direct: DataFrame, uid: int, pattern: str, start: str, top: int) -> DataFrame:
    """path, size: the user's directories below ``start`` whose own name fits, by direct size."""
    rows = descendants(direct.where(F.col("uid") == uid).withColumn("path", F.col("dir")), start)
    return rows.where(F.substring_index("path", "/", -1).ilike(f"%{pattern}%")).select("path", "size").orderBy(F.desc("size"), "path").limit(top)


def unknown_users(requested: DataFrame, known: DataFrame) -> DataFrame:
    return requested.select("name").join(known.select(F.col("username").alias("name")), "name", "left_anti")


def export_rows(files: DataFrame, direct: DataFrame, usernames: DataFrame) -> DataFrame:
    """kind, username, path, size of everything the per-user export writes."""
    dirs = named(user_usage(direct), usernames).select(F.lit("dir").alias("kind"), "username", "path", F.col("used").alias("size"))
    own = named(files.select("uid", "path", "size"), usernames).select(F.lit("file").alias("kind"), "username", "path", "size")
    return dirs.unionByName(own)

