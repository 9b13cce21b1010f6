"""Path expressions. All take and return columns; ``/`` separates, roots have no trailing slash but ``/`` itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(path: Column) -> Column:
    """Control characters other than TAB become U+FFFD."""
    return F.regexp_replace(path, r"[\p{Cc}&&[^\t]]", "�")


def trimmed(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def normalize_root(path: Column) -> Column:
    """Without trailing slashes; empty means ``/``."""
    bare = trimmed(path)
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def parent(path: Column) -> Column:
    """Parent directory; null for the root, the empty path and names without a slash."""
    bare = trimmed(path)
    up = F.regexp_replace(bare, "/[^/]*$", "")
    return F.when(~F.contains(bare, F.lit("/")), F.lit(None)).when(up == "", F.lit("/")).otherwise(up)


def parent_or_root(path: Column) -> Column:
    return F.coalesce(parent(path), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(trimmed(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; empty for dot files and names without a dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^.+\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def segments(path: Column) -> Column:
    """Names from the top down; the root has none."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def from_segments(segs: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segs, "/"))


def ancestors(segs: Column, top: int = 0) -> Column:
    """Segment lists of the directory at depth ``top`` on the way, of every one below it, and of the path itself."""
    return F.transform(F.sequence(F.lit(top), F.size(segs)), lambda n: F.slice(segs, F.lit(1), n))


def levels(root: str) -> int:
    """How many names a path has."""
    return len([s for s in root.split("/") if s])


def under(path: Column, root: Column | str) -> Column:
    """True for the root itself and everything below it, by whole names."""
    root = F.lit(root) if isinstance(root, str) else root
    return (root == "/") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def absolute(path: Column, scan_root: Column | str) -> Column:
    """Absolute path of one that is relative to the scan root or begins with the root's last name."""
    root = trimmed(F.lit(scan_root) if isinstance(scan_root, str) else scan_root)
    base = F.substring_index(root, "/", -1)
    inside = (base != "") & ((path == base) | F.startswith(path, F.concat(base, F.lit("/"))))
    return F.when(F.startswith(path, F.lit("/")), path).when(inside, F.concat(root, F.substring(path, F.length(base) + 1, F.length(path)))).otherwise(F.concat(root, F.lit("/"), path))


def join_path(directory: Column, name: Column) -> Column:
    """Directory and name; an empty directory gives the name alone."""
    return F.when(F.coalesce(directory, F.lit("")) == "", name).when(directory == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(directory, F.lit("/"), name))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def bucket(uid: Column, buckets: int = 3) -> Column:
    return F.pmod(uid, F.lit(buckets))


def clamp_depth(path: Column, levels: int) -> Column:
    """The ancestor at the given depth, or the path itself if it is not deeper."""
    return from_segments(F.slice(segments(path), 1, levels))
