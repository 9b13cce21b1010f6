"""Command line: configuration, a run over a directory, reports, details, trees.

``python -m tallystone.cli --help``
"""

from __future__ import annotations

import argparse
import errno
import os
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import notify
from .config import Config
from .functions import render
from .functions.paths import normalize_root
from .operators import classify, compare, facts, issues, mounts, reports, scan
from .operators import tree as trees
from .plans import build
from .sources import documents, filesystem, sinks
from .staging import staged
from .status import Heartbeat
from .sync import Target

#: Exit status of a run that found no space to write to.
NO_SPACE = 2
TABLES = ["users", "dirs", "files", "file_names", "treemap", "names", "owners", "issues"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallystone")
    p.add_argument("--config", default="tallystone.json")
    p.add_argument("--init", action="store_true")
    p.add_argument("--dir")
    p.add_argument("--add-team")
    p.add_argument("--add-user", nargs="+")
    p.add_argument("--team")
    p.add_argument("--remove-user", nargs="+")
    p.add_argument("--list", action="store_true")
    p.add_argument("--run", action="store_true")
    p.add_argument("--workers", type=int)
    p.add_argument("--prefix", default="")
    p.add_argument("--date", action="store_true")
    p.add_argument("--output")
    p.add_argument("--output-dir", default=".")
    p.add_argument("--tree-map", action="store_true")
    p.add_argument("--webhook-url")
    p.add_argument("--sync", action="store_true")
    p.add_argument("--sync-pass", default="")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--sync-host")
    p.add_argument("--sync-user", default="")
    p.add_argument("--sync-dest-dir")
    p.add_argument("--level", type=int, default=3)
    p.add_argument("--show-report", action="store_true")
    p.add_argument("--files", nargs="+")
    p.add_argument("--detail", action="store_true")
    p.add_argument("--tree-show", action="store_true")
    p.add_argument("--export", action="store_true")
    p.add_argument("--type", choices=["report", "inode", "permission", "files", "dirs"], default="report")
    p.add_argument("--top", type=int, default=30)
    p.add_argument("--path", default="")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--search", default="")
    p.add_argument("--user", nargs="+")
    p.add_argument("--compare-by", choices=["usage", "growth"], default="growth")
    return p


def session(workers: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName("tallystone")
    if workers and "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{workers}]")
    return b.config("spark.sql.adaptive.enabled", "true").getOrCreate()


def run(spark: SparkSession, config: dict, folder: str, output: str, prefix: str = "", level: int = 3, targets: list[str] | None = None, tree_map: bool = True, beat: Heartbeat | None = None) -> dict:
    """Scan the configured directory, write the tables and the reports; returns the usage report."""
    if beat is None:
        with Heartbeat(folder) as own:
            return run(spark, config, folder, output, prefix, level, targets, tree_map, own)
    root, began = config["directory"].rstrip("/") or "/", int(time.time())
    skip = [os.path.join(root, s) if not s.startswith("/") else s for s in config.get("exclude_patterns", [])]
    twice = [r[0] for r in mounts.duplicate_mounts(documents.mount_lines(spark), root).collect()]
    walked = staged(filesystem.entries(spark, root, skip, twice))
    entries = staged(scan.entered_once(walked))
    names = documents.host_usernames(spark)
    users, teams = documents.config_tables(spark, config)
    wanted = names.join(spark.createDataFrame([(u,) for u in targets], "username string"), "username", "left_semi").select("uid") if targets else None
    beat.phase("report")
    files = staged(build.files_of(entries, wanted))
    counts = scan.counters(entries.where("error is null")).first().asDict()
    sizes = files.groupBy("uid").agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    rows = staged(classify.classified(sizes, names, users, teams))
    room = documents.capacity(root)
    report = sinks.usage_report(classify.summary(rows), root, began, room)
    sinks.write_json(report, output)
    inodes = sinks.inode_report(rows.select(F.col("username").alias("name"), "inodes"), root, began, room, counts["total_inodes"])
    sinks.write_json(inodes, sinks.sibling_path(output, "inode_usage_report", prefix))
    beat.phase("treemap" if tree_map else "detail")
    made = build.tables(files, names, users, build.owners_of(entries), build.issues_of(entries), level, root, tree_map)
    made["issues"] = staged(made["issues"])
    counted = [r.asDict() for r in issues.by_user(made["issues"]).orderBy("user").collect()]
    total = {"scan_root": root, "scan_timestamp": str(began), "schema_version": "1", "issues": str(sum(r["issues"] for r in counted)), **{k: str(v) for k, v in counts.items()}}
    made["meta"] = facts.meta_rows(total, spark)
    sinks.write_tables(made, folder)
    report["scan"] = {"seconds": max(1, int(time.time()) - began), "issues": counted, **counts}
    return report


def run_summary(report: dict, files: list[str]) -> str:
    """What a run prints: totals and rate, capacity, teams, the largest users, issue counts, and what was written."""
    found, room = report["scan"], report["general_system"]
    whole = room.get("total") or 1
    share = lambda used: f"{render.bar(used / whole * 100)} {used / whole * 100:.1f}%"
    rate = found["total_files"] / found["seconds"]
    out = [
        f"{found['total_files']} files, {found['total_dirs']} directories, {render.size_text(found['total_size'])} in {found['seconds']} s ({rate:.0f} files a second)",
        f"Capacity {render.size_text(room.get('total', 0))}, used {render.size_text(room.get('used', 0))}, free {render.size_text(room.get('available', 0))}",
    ]
    others = sum(r["used"] for r in report["other_usage"])
    # as on the console: the other users' sum replaces what the team of that name had
    teams = sorted([*(r for r in report["team_usage"] if r["name"] != classify.OTHER), {"name": classify.OTHER, "used": others}], key=lambda r: (-r["used"], r["name"]))
    parts = [("team", teams, "Teams"), ("user", report["user_usage"][:20], "Largest users"), ("user", report["other_usage"][:20], "Largest other users")]
    out += [render.table([head, "used", "share"], [(r["name"], render.size_text(r["used"]), share(r["used"])) for r in rows], title) for head, rows, title in parts if rows]
    if found["issues"]:
        out.append(render.table(["user", "issues"], [(r["user"], r["issues"]) for r in found["issues"]], "Entries that could not be read"))
    out += [f"{path}  ({render.size_text(os.path.getsize(path))})" for path in files if os.path.isfile(path)]
    return "\n".join(out)


def show_reports(spark: SparkSession, files: list[str], users: list[str] | None, by: str) -> str:
    """One report's usage, or the comparison of several."""
    if lost := documents.unreadable(files):
        return "\n".join(lost)
    rows = documents.reports(spark, files)
    if len(files) == 1:
        total = (documents.load_json(files[0]).get("general_system") or {}).get("total") or 1
        shown = reports.standard_report(rows.select(F.col("source").alias("section"), "name", "used"), users).collect()
        return render.table(["section", "name", "used", "share"], [(r["section"], r["name"], render.size_text(r["used"]), f"{r['used'] / total * 100:.1f} %") for r in shown], "Usage")
    points = compare.series(compare.latest_of_day(rows))
    if users:
        points = points.where(F.col("name").isin(users))
    names = sorted(r[0] for r in compare.selected(points, by).collect())
    growth = {r["name"]: r for r in compare.growth(points.where(F.col("name").isin(names))).collect()}
    table = compare.pivoted(points.where(F.col("name").isin(names)), names).orderBy("day").collect()
    lines = [(str(datetime.fromtimestamp(r["day"] * 86400).date()), *(render.size_text(r[n]) for n in names)) for r in table]
    lines.append(("growth", *(render.size_text(growth[n]["growth"]) for n in names)))
    lines.append(("percent", *("N/A" if growth[n]["percent"] is None else f"{growth[n]['percent']:.1f} %" for n in names)))
    lines.append(("trend", *(growth[n]["trend"] for n in names)))
    return render.table(["date", *names], lines, "Comparison")


def files_with_paths(t: dict[str, DataFrame]) -> DataFrame:
    """path, uid, size of the files of the tables."""
    dirs = t["dirs"].select("dir_id", F.col("path").alias("dir")).distinct()
    rows = t["files"].join(t["file_names"].withColumnRenamed("id", "name_id"), "name_id").join(dirs, "dir_id", "left")
    return rows.select(F.concat(F.when(F.col("dir") == "/", "").otherwise(F.col("dir")), F.lit("/"), "name").alias("path"), "uid", "size")


def detail(spark: SparkSession, folder: str, users: list[str], kind: str, top: int, search: str) -> str:
    t = sinks.read_tables(spark, folder, [*TABLES, "meta"], "detail_")
    if "users" not in t:
        return f"No tables in {folder}."
    known = {r["username"]: r["uid"] for r in t["users"].where(F.col("username").isin(users)).select("username", "uid").collect()}
    direct = t["dirs"].select(F.col("path").alias("dir"), "uid", "size", "files")
    out = []
    for user in users:
        if user not in known:
            out.append(f"Unknown user: {user}")
            continue
        uid = known[user]
        if kind in ("report", "dirs"):
            found = reports.user_dirs(direct, uid, top, search).limit(top).collect()
            out.append(render.table(["used", "directory"], [(render.size_text(r["used"]), r["path"]) for r in found], f"{user}: top {len(found)} directories"))
        if kind in ("report", "files"):
            found = reports.user_files(files_with_paths(t), uid, top, search).collect()
            out.append(render.table(["size", "file"], [(render.size_text(r["size"]), r["path"]) for r in found], f"{user}: top {len(found)} files"))
        if kind in ("report", "inode"):
            found = reports.user_inodes(direct, uid, top, search).collect()
            out.append(render.table(["files", "directory"], [(r["files"], r["path"]) for r in found], f"{user}: inodes"))
        if kind in ("report", "permission"):
            found = issues.of_user(t["issues"], user, top, search).collect()
            total = found[0]["total"] if found else 0
            out.append(render.table(["type", "error", "path"], [(r["item_type"], r["error"], r["path"]) for r in found], f"{user}: top {len(found)} of {total} issues"))
    return "\n".join(out)


def show_tree(spark: SparkSession, folder: str, start: str, level: int, limit: int, search: str, user: str | None) -> str:
    t = sinks.read_tables(spark, folder, [*TABLES, "meta"], "tm_")
    if "treemap" not in t:
        return f"No tables in {folder}."
    root = facts.meta_value(t["meta"], "scan_root").first()["value"] or "/"
    start = spark.range(1).select(normalize_root(F.lit(start or root))).first()[0]
    if user:
        uid = t["users"].where(F.col("username") == user).select("uid").first()
        if uid is None:
            return f"Unknown user: {user}"
        direct = t["dirs"].where(F.col("uid") == uid[0]).select(F.col("path").alias("dir"), "uid", "size", "files")
        if search:
            found = reports.flat_user_search(direct, uid[0], search, start, limit).collect()
            return "\n".join(f"{render.size_text(r['size']):>10}  {r['path']}" for r in found) or "No match."
        rows = trees.subtree_usage(direct).where("total_size > 0")
    else:
        rows = t["treemap"].select("path", "total_size")
        if search:
            found = reports.flat_search(rows, search, start, limit).collect()
            more = [f"Total {found[0]['matches']}"] if found else ["No match."]
            return "\n".join([f"{render.size_text(r['total_size']):>10}  {r['path']}" for r in found] + more)
    shown = trees.view(rows.select("path", "total_size"), start, max(1, level), limit, "total_size").collect()
    return render.tree([r.asDict() for r in shown], start, "total_size")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = Config(a.config)
    said: list[str] = []
    if a.init:
        said.append(config.init(a.dir or os.getcwd()))
    elif a.dir:
        said.append(config.set_directory(a.dir))
    if a.add_team:
        said.append(config.add_team(a.add_team))
    said += [config.add_user(u, a.team or "") for u in a.add_user or []]
    said += [config.remove_user(u) for u in a.remove_user or []]
    if not (a.run or a.sync or a.list or a.show_report or a.detail or a.tree_show or a.export):
        print("\n".join(said))
        return 0
    spark = session(a.workers)
    if a.list:
        members = classify.team_members(*documents.config_tables(spark, config.data), a.team or "").orderBy("team", "name").collect()
        for team in sorted({r["team"] for r in members}):
            said += [team, render.grid([r["name"] for r in members if r["team"] == team])]
    if a.run:
        output = sinks.output_path(config.data.get("output_file", "report.json"), a.output_dir, a.output, a.prefix, datetime.now() if a.date else None)
        try:
            with Heartbeat(a.output_dir) as beat:
                report = run(spark, config.data, a.output_dir, output, a.prefix, a.level, a.user, a.tree_map, beat)
                if a.sync_host:
                    beat.phase("sync")
                    if not Target(a.sync_host, a.sync_dest_dir or a.output_dir, a.sync_user, password=a.sync_pass).push_folder(a.output_dir, compress=True):
                        said.append("The copy to the other host failed.")
        except KeyboardInterrupt:
            print("Stopped. Tables and reports of the last whole run stay.")
            return 130
        except Exception as e:
            if a.debug:
                raise
            print(f"The run failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
            return NO_SPACE if isinstance(e, OSError) and e.errno == errno.ENOSPC or "No space left on device" in str(e) else 1
        said.append(run_summary(report, [output, sinks.sibling_path(output, "inode_usage_report", a.prefix), os.path.join(a.output_dir, sinks.CURRENT)]))
        if a.webhook_url and not notify.send(a.webhook_url, report):
            said.append("The notification was not delivered.")
    elif a.sync and a.sync_host and not Target(a.sync_host, a.sync_dest_dir or a.output_dir, a.sync_user, password=a.sync_pass).push_folder(a.output_dir, compress=True):
        said.append("The copy to the other host failed.")
    if a.show_report:
        said.append(show_reports(spark, documents.expand(a.files or []), a.user, a.compare_by))
    if a.detail:
        said.append(detail(spark, a.output_dir, a.user or [], a.type, max(1, a.top), a.search))
    if a.tree_show:
        said.append(show_tree(spark, a.output_dir, a.path, a.level, a.limit, a.search, a.user[0] if a.user else None))
    if a.export:
        t = sinks.read_tables(spark, a.output_dir, TABLES)
        direct = t["dirs"].select(F.col("path").alias("dir"), "uid", "size", "files")
        rows = reports.export_rows(files_with_paths(t), direct, t["users"].select("uid", "username"))
        sinks.export_users(rows if not a.user else rows.where(F.col("username").isin(a.user)), os.path.join(a.output_dir, "export"))
    print("\n".join(said))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
