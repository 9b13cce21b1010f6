"""A live directory tree as a Python data source: ``spark.read.format("disk_entries")``.

Every task walks some subtrees. Skipped directories, critical names, nested
mounts and other devices are pruned in the walk, before anything below them is
looked at. Symbolic links are reported, never followed. Options: ``path`` (the
root), ``skip`` (directories, one a line), ``mounts`` (mount points to skip, one
a line), ``split`` (levels below the root that become tasks of their own).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formats import ERROR_SIGNS
from ..operators.scan import CRITICAL_NAMES

SCHEMA = "path string, kind string, uid long, size long, ino long, dev long, nlink long, error string"


def code_of(message: str) -> str:
    return next((code for code, signs in ERROR_SIGNS.items() if any(s in message for s in signs)), "EOTHER")


class Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.skip = {s.rstrip("/") for s in (options.get("skip", "") + "\n" + options.get("mounts", "")).split("\n") if s}
        self.split = int(options.get("split", 2))

    def pruned(self, path: str) -> bool:
        return path in self.skip or os.path.basename(path) in CRITICAL_NAMES

    def partitions(self) -> list[InputPartition]:
        """The directories down to ``split`` levels one by one, what is below them as a whole."""
        out, level = [], [self.root]
        for depth in range(self.split + 1):
            last = depth == self.split
            out += [Subtree(p, last) for p in level]
            if last:
                break
            nxt = []
            for p in level:
                try:
                    with os.scandir(p) as it:
                        nxt += sorted(e.path for e in it if e.is_dir(follow_symlinks=False) and not self.pruned(e.path))
                except OSError:
                    pass
            level = nxt
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.pruned(self.root):
            return
        try:
            device = os.lstat(self.root).st_dev
        except OSError as e:
            yield (self.root, "directory", 0, 0, 0, 0, 0, code_of(f"{e.strerror} (os error {e.errno})"))
            return
        todo, seen = [partition.path], set()
        while todo:
            path = todo.pop()
            try:
                own = os.lstat(path)
            except OSError as e:
                yield (path, "directory", 0, 0, 0, 0, 0, code_of(f"{e.strerror} (os error {e.errno})"))
                continue
            if own.st_dev != device or (own.st_dev, own.st_ino) in seen:
                continue
            seen.add((own.st_dev, own.st_ino))
            yield (path, "dir", own.st_uid, 0, own.st_ino, own.st_dev, own.st_nlink, None)
            try:
                with os.scandir(path) as it:
                    entries = sorted(it, key=lambda e: e.name)
            except OSError as e:
                yield (path, "directory", own.st_uid, 0, 0, 0, 0, code_of(f"{e.strerror} (os error {e.errno})"))
                continue
            below = []
            for e in entries:
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError as x:
                    yield (e.path, "file", 0, 0, 0, 0, 0, code_of(f"{x.strerror} (os error {x.errno})"))
                    continue
                if stat.S_ISLNK(s.st_mode):
                    yield (e.path, "symlink", s.st_uid, 0, s.st_ino, s.st_dev, s.st_nlink, None)
                elif stat.S_ISDIR(s.st_mode):
                    if partition.deep and not self.pruned(e.path):
                        below.append(e.path)
                elif stat.S_ISREG(s.st_mode) and s.st_dev == device:
                    yield (e.path, "file", s.st_uid, s.st_blocks * 512, s.st_ino, s.st_dev, s.st_nlink, None)
            todo += reversed(below)


class DiskEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "disk_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EntryReader(self.options)


def entries(spark: SparkSession, root: str, skip: list[str] = (), mounts: list[str] = (), split: int = 2) -> DataFrame:
    """path, kind, uid, size, ino, dev, nlink, error of everything below ``root``."""
    spark.dataSource.register(DiskEntries)
    return spark.read.format("disk_entries").option("path", root).option("skip", "\n".join(skip)).option("mounts", "\n".join(mounts)).option("split", split).load()
