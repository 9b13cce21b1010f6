"""Fact tables as Parquet, report documents, per-user exports."""

from __future__ import annotations

import json
import os
import shutil
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import safe_file_name


#: The file that names the folder of a scan's tables, and what such folders are called.
CURRENT, VERSION = "tables.json", "tables-"
#: In what order each file of a table has its rows, so that readers skip what they do not ask for.
ORDERS = {"dirs": ["dir_id", "uid"], "users": ["uid"], "owners": ["uid"]}


def write_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """One Parquet table each in a new folder, which ``folder`` names once all are there; readers see all old or all new tables.

    Folders of earlier runs, whole or cut short, go afterwards. Returns the folder.
    """
    version = f"{VERSION}{time.time_ns():x}"
    for name, rows in tables.items():
        if name in ORDERS and set(ORDERS[name]) <= set(rows.columns):
            rows = rows.sortWithinPartitions(*ORDERS[name])
        rows.write.option("compression", "zstd").parquet(f"{folder}/{version}/{name}")
    write_json({"folder": version}, os.path.join(folder, CURRENT))
    for old in os.listdir(folder):
        if old.startswith(VERSION) and old != version:
            shutil.rmtree(os.path.join(folder, old), ignore_errors=True)
    return f"{folder}/{version}"


def tables_folder(folder: str) -> str | None:
    """Where the tables are that ``folder`` names."""
    try:
        with open(os.path.join(folder, CURRENT), encoding="utf-8") as f:
            return os.path.join(folder, json.load(f)["folder"])
    except (OSError, ValueError, KeyError):
        return None


def read_tables(spark: SparkSession, folder: str, names: list[str], prefix: str = "") -> dict[str, DataFrame]:
    """The tables that are there, also as views ``<prefix><name>``."""
    out = {}
    at = tables_folder(folder) or folder
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{at}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out[name].createOrReplaceTempView(prefix + name)
    return out


def find_tables(hint: str, needed: str = "users", most: int = 6) -> str | None:
    """The folder that names a place with the table ``needed``: the hint or one of its parents."""
    at = os.path.abspath(hint)
    for _ in range(most + 1):
        if os.path.isdir(os.path.join(tables_folder(at) or at, needed)):
            return at
        at = os.path.dirname(at)
    return None


def output_path(base: str, folder: str | None = None, override: str | None = None, prefix: str = "", day: datetime | None = None) -> str:
    """Report file name: prefix, base name and date joined by ``_``."""
    path = override or (os.path.join(folder, os.path.basename(base)) if folder else base)
    stem, ext = os.path.splitext(os.path.basename(path))
    name = "_".join(p for p in (prefix, stem, day.strftime("%Y%m%d") if day else "") if p) + ext
    return os.path.join(os.path.dirname(path), name)


def sibling_path(output: str, base: str, prefix: str = "") -> str:
    """Reports beside the main one: no date."""
    return os.path.join(os.path.dirname(output), "_".join(p for p in (prefix, base) if p) + ".json")


def compact_json(document: object, indent: int = 4) -> str:
    """Indented JSON in which an object of plain values takes one line."""
    lines: list[str] = []

    def plain(value: object) -> bool:
        return not isinstance(value, (dict, list, tuple))

    def put(value: object, lead: str, depth: int, tail: str) -> None:
        pad = " " * (indent * depth)
        if isinstance(value, dict) and value and (not all(map(plain, value.values())) or not depth):
            lines.append(f"{pad}{lead}{{")
            for i, (key, inner) in enumerate(value.items()):
                put(inner, f"{json.dumps(str(key))}: ", depth + 1, "," * (i < len(value) - 1))
            lines.append(f"{pad}}}{tail}")
        elif isinstance(value, (list, tuple)) and value:
            lines.append(f"{pad}{lead}[")
            for i, inner in enumerate(value):
                put(inner, "", depth + 1, "," * (i < len(value) - 1))
            lines.append(f"{pad}]{tail}")
        elif isinstance(value, dict) and value:
            pairs = ", ".join(f"{json.dumps(str(k))}: {json.dumps(v)}" for k, v in value.items())
            lines.append(f"{pad}{lead}{{ {pairs} }}{tail}")
        else:
            lines.append(f"{pad}{lead}{json.dumps(value)}{tail}")

    put(document, "", 0, "")
    return "\n".join(lines)


def write_json(document: object, path: str) -> None:
    """All or nothing: a temporary file takes the name when it is complete."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(compact_json(document))
    os.replace(path + ".tmp", path)


def usage_report(summary: DataFrame, directory: str, taken_at: int, capacity: dict[str, int]) -> dict:
    """The report document. ``summary``: section, name, used, team_id - a row a user or team, never a file."""
    rows = summary.orderBy(F.desc("used"), "name").collect()

    def part(section: str, with_team: bool) -> list[dict]:
        return [{"name": r["name"], "used": r["used"]} | ({"team_id": r["team_id"]} if with_team and r["team_id"] is not None else {}) for r in rows if r["section"] == section]

    return {
        "date": taken_at,
        "directory": directory,
        "general_system": {k: v for k, v in capacity.items() if not k.startswith("inodes_")},
        "team_usage": part("team", True),
        "user_usage": part("user", True),
        "other_usage": part("other", False),
    }


def inode_report(counts: DataFrame, directory: str, taken_at: int, capacity: dict[str, int], scanned: int) -> dict:
    users = [r.asDict() for r in counts.orderBy(F.desc("inodes"), "name").collect()]
    return {"date": taken_at, "directory": directory, "inodes_total": capacity.get("inodes_total", 0), "inodes_used": capacity.get("inodes_used", 0), "inodes_free": capacity.get("inodes_free", 0), "inodes_scanned": scanned, "users": users}


def export_users(rows: DataFrame, folder: str) -> None:
    """kind, username, path, size as text, a folder for each kind and user, largest first; users without rows leave none.

    Rows are dealt by (kind, user, size), so a user with very many files is
    written by several tasks, in order from file to file.
    """
    named = rows.select("kind", safe_file_name(F.col("username")).alias("user"), "size", F.concat_ws("\t", F.col("size").cast("string"), "path").alias("value"), "path")
    ordered = named.repartitionByRange("kind", "user", F.desc("size"), "path").sortWithinPartitions("kind", "user", F.desc("size"), "path")
    ordered.select("kind", "user", "value").write.mode("overwrite").partitionBy("kind", "user").text(folder)
