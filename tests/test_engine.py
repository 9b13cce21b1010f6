"""The engine against plain Python, small fixtures and a live directory."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallystone import cli, notify, status, sync
from tallystone.config import Config
from tallystone.functions import formats, paths, render
from tallystone.operators import compare, issues, mounts, numbering, scan, tree
from tallystone.plans import build
from tallystone.sources import documents, event_files, filesystem, permission_lines, sinks
from tallystone.streaming import incremental

FILES = [(1000, 4096, "/r/alpha.txt"), (1000, 2048, "/r/sub/shared.log"), (1000, 512, "/r/sub/same.bin"), (1001, 8192, "/r/other/alpha.txt"), (1001, 1024, "/r/other/logs/shared.log")]
NAMES = [(1000, "alice"), (1001, "bob")]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "uid long, size long, path string")


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (500, "500 B"), (1000, "1000 B"), (1_500_000, "1 MB"), (2_000_000_000, "1.9 GB"), (3_000_000_000_000, "2.73 TB"), (-1, "0 B"), (2560, "2 KB"), (3584, "4 KB")])
def test_size_text(spark, size, text):
    assert one(spark, formats.size_text(F.lit(size).cast("long"))) == text == render.size_text(size)


@pytest.mark.parametrize(
    ("epoch", "text"),
    [(1_500_000_000, "2017-07-14 02:40:00"), (-1, "1969-12-31 23:59:59"), (-62_000_000_000, "0005-04-19 09:46:40"), (253_402_300_799, "9999-12-31 23:59:59"), (253_402_300_800, "10000-01-01 00:00:00"), (1_000_000_000_000, "33658-09-27 01:46:40"), (9_223_372_036_853, "294247-01-10 04:00:53")],
)
def test_times_of_all_years(spark, epoch, text):
    at = F.lit(epoch).cast("long")
    assert one(spark, formats.timestamp_text(at)) == text
    assert one(spark, formats.date_text(at)) == text.split()[0]


@pytest.mark.parametrize(("path", "up", "ext"), [("/a/b.tar.GZ", "/a", "gz"), ("/a", "/", ""), ("/", None, ""), ("", None, ""), ("a.txt", None, "txt"), ("/x/.bashrc", "/x", ""), ("/x/foo.", "/x", ""), ("/x/y//", "/x", "")])
def test_path_parts(spark, path, up, ext):
    assert one(spark, paths.parent(F.lit(path))) == up
    assert one(spark, paths.extension(F.lit(path))) == ext


def test_facts(spark, files):
    users = spark.createDataFrame([("alice", "1")], "name string, team_id string")
    names = spark.createDataFrame(NAMES, "uid long, username string")
    owners = spark.createDataFrame([("/r/sub", 7)], "path string, owner_uid long")
    events = spark.createDataFrame([(1000, "directory", "EACCES", "/r/secret"), (1001, "file", "ENOENT", "/r/ghost.txt"), (0, "directory", "EIO", "/r/bad_disk")], "uid long, kind string, errcode string, path string")
    made = build.tables(files, names, users, owners, events, 0)
    assert {(r.username, r.team_id, r.total_files, r.total_size) for r in made["users"].collect()} == {("alice", "1", 3, 6656), ("bob", "", 2, 9216)}
    assert sorted(r.size for r in made["dirs"].where("uid = 1001").collect()) == [1024, 8192]
    top = {r.path: r for r in made["treemap"].collect()}
    assert top["/"].total_size == 15872 and top["/"].dir_id == 0 and top["/"].has_files == 0
    assert top["/r"].dir_count == 2 and top["/r"].file_count == 1 and top["/r/sub"].owner_uid == 7 and top["/r/other"].owner_uid == 7
    assert [(r.id, r.user, r.error) for r in made["issues"].orderBy("id").collect()] == [(1, "__unknown__", "EIO"), (2, "alice", "EACCES"), (3, "bob", "ENOENT")]


def bfs(dirs):
    found = {()}
    for d in dirs:
        segs = tuple(s for s in d.split("/") if s)
        found |= {segs[:i] for i in range(len(segs) + 1)}
    return sorted(found, key=lambda s: (len(s), s))


def test_numbers_are_breadth_first(spark):
    dirs = ["/b/c", "/b/a/x/y", "/a", "/a-b/z", "/b/c/d", "/é/q", "/a/z"]
    rows = tree.numbered(tree.closure(spark.createDataFrame([(d,) for d in dirs], "dir string"))).orderBy("dir_id").collect()
    want = bfs(dirs)
    assert [tuple(r.segs) for r in rows] == want and [r.dir_id for r in rows] == list(range(len(want)))
    assert all(r.parent_id == (None if not r.segs else want.index(tuple(r.segs[:-1]))) for r in rows)


def test_user_rollup_skips_directories_without_files(spark):
    direct = spark.createDataFrame([("/a", 1, 10, 1), ("/a/b/c", 1, 5, 1), ("/a/b", 2, 7, 1)], "dir string, uid long, size long, files long")
    assert {(r.uid, r.path, r.used) for r in tree.user_usage(direct).collect()} == {(1, "/a", 15), (1, "/a/b/c", 5), (2, "/a/b", 7)}


def test_growth_and_trend(spark):
    rows = [("up", [1, 2, 3, 4]), ("down", [4, 3, 2, 1]), ("flat", [5, 5, 5, 5]), ("mixed", [1, 5, 2, 6]), ("late", [0, 0, 4, 8]), ("none", [0, 0, 0, 0]), ("gone", [3, 2, 1, 0])]
    points = spark.createDataFrame([(d, n, v) for n, own in rows for d, v in enumerate(own)], "day long, name string, used long")
    got = {r.name: (r.growth, r.percent, r.trend) for r in compare.growth(points).collect()}
    assert got == {"up": (3, 300.0, "^"), "down": (-3, -75.0, "v"), "flat": (0, 0.0, "-"), "mixed": (5, 500.0, "~"), "late": (4, 100.0, "~"), "none": (0, None, "-"), "gone": (-3, -100.0, "v")}
    assert compare.growth(points.where("day = 0 and name = 'up'")).first()[1:] == (0, None, "-")


def test_growth_between_two_reports(spark):
    points = spark.createDataFrame([(0, "a", 2), (1, "a", 5)], "day long, name string, used long")
    assert compare.growth(points).first()[1:] == (3, 150.0, "-")


def test_event_files(spark, tmp_path):
    (tmp_path / "scan_t0_b0.bin").write_bytes(event_files.pack("scan_t", FILES[:3]))
    (tmp_path / "scan_t1_b0.bin").write_bytes(event_files.pack("scan_t", FILES[3:])[8:] + b"\x01\x00\x00\x00" + b"\x00" * 8 + b"\x63\x00\x00\x00")
    (tmp_path / "dirowner_t0.bin").write_bytes(event_files.pack("dirowner_t", [(5, "/r/a\x01b")]))
    assert sorted(map(tuple, event_files.read(spark, str(tmp_path)).collect())) == sorted(FILES)
    assert [tuple(r) for r in event_files.read(spark, str(tmp_path), "dirowner_t").collect()] == [(5, None, "/r/a�b")]


def test_permission_lines(spark, tmp_path):
    (tmp_path / "perm_t0.tsv").write_bytes(b"P\t1000\tfile\tEIO\t/a\tb\nP\t1\nX\t1\tfile\tEIO\t/a\nP\tx\tfile\tEIO\t/a\n\xff\xfe\n")
    assert [tuple(r) for r in permission_lines.read_lines(spark, str(tmp_path)).collect()] == [(1000, "file", "EIO", "/a\tb")]


def test_live_directory(spark, tmp_path):
    root = tmp_path / "top"
    (root / "a/b").mkdir(parents=True)
    (root / ".snapshot/x").mkdir(parents=True)
    (root / "skipped/deep").mkdir(parents=True)
    for p in ("one", "a/two", "a/b/three", ".snapshot/x/no", "skipped/deep/no"):
        (root / p).write_bytes(b"x" * 5000)
    os.link(root / "one", root / "a/b/linked")
    (root / "a/link").symlink_to(root / "one")
    rows = filesystem.entries(spark, str(root), [str(root / "skipped")], split=1)
    kinds = {(r.path.removeprefix(str(root)), r.kind) for r in rows.collect()}
    assert kinds == {("", "dir"), ("/one", "file"), ("/a", "dir"), ("/a/two", "file"), ("/a/link", "symlink"), ("/a/b", "dir"), ("/a/b/three", "file"), ("/a/b/linked", "file")}
    assert rows.count() == len(kinds)
    assert sorted(os.path.basename(r.path) for r in build.files_of(rows).collect()) == ["linked", "three", "two"]
    assert scan.counters(rows).first().total_inodes == 8


def test_visited_directories(spark):
    dirs = spark.createDataFrame([("/a", 1), ("/a/x", 2), ("/b", 1), ("/b/x", 3), ("/bb", 4)], "path string, ino long").withColumn("dev", F.lit(1))
    assert sorted(r.path for r in scan.visited_once(dirs).collect()) == ["/a", "/a/x", "/bb"]


def test_entries_without_a_link_count(spark):
    rows = spark.createDataFrame([("/a", 1, 0), ("/b", 2, None), ("/c", 3, 1), ("/d", 4, 2), ("/e", 4, 2)], "path string, ino long, nlink long")
    rows = rows.select("*", F.lit(1).alias("dev"), F.lit(7).alias("uid"), F.lit(5).alias("size"), F.col("ino").alias("tie"))
    assert sorted(r.path for r in scan.one_per_inode(rows).collect()) == ["/a", "/b", "/c", "/d"]


TWICE = [("/r", "dir", 1, 2), ("/r/a", "dir", 2, 3), ("/r/a/s", "dir", 3, 2), ("/r/a/f", "file", 10, 1), ("/r/a/s/g", "file", 11, 1)]
TWICE += [("/r/a-b", "dir", 2, 3), ("/r/a-b/s", "dir", 3, 2), ("/r/a-b/f", "file", 10, 1), ("/r/a-b/s/g", "file", 11, 1), ("/r/a-b/t", "dir", 4, 2), ("/r/a-b/t/h", "file", 12, 1)]


def entries(spark):
    data = [(p, k, 7, 4096 if k == "file" else 0, i, 1, n, None) for p, k, i, n in TWICE]
    return spark.createDataFrame(data, filesystem.SCHEMA)


def test_directories_are_entered_once(spark):
    got = sorted(r.path for r in scan.entered_once(entries(spark)).collect())
    assert got == ["/r", "/r/a", "/r/a-b/t", "/r/a-b/t/h", "/r/a/f", "/r/a/s", "/r/a/s/g"]


def test_run_counts_a_directory_met_twice_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filesystem, "entries", lambda *_: entries(spark))
    config = Config(str(tmp_path / "c.json"))
    config.init("/r")
    report = cli.run(spark, config.data, str(tmp_path), str(tmp_path / "r.json"), level=0)
    assert sum(r["used"] for r in report["user_usage"] + report["other_usage"]) == 3 * 4096


def test_run_and_show(spark, tmp_path, capsys):
    root, out = tmp_path / "data", tmp_path / "out"
    (root / "x/y").mkdir(parents=True)
    out.mkdir()
    (root / "x/y/f.txt").write_bytes(b"z" * 9000)
    config = Config(str(tmp_path / "c.json"))
    config.init(str(root))
    assert config.add_user("root", "lab") == "There is no team lab."
    config.add_team("lab")
    config.add_user("root", "lab")
    report = cli.run(spark, config.data, str(out), str(out / "r.json"), level=0)
    used = sum(r["used"] for r in report["user_usage"] + report["other_usage"])
    assert used == (root / "x/y/f.txt").stat().st_blocks * 512
    assert json.loads((out / "r.json").read_text())["directory"] == str(root)
    assert json.loads((out / "scan_status.json").read_text())["stage"] == "done"
    user = (report["user_usage"] + report["other_usage"])[0]["name"]
    assert "f.txt" in cli.detail(spark, str(out), [user, "nobody"], "report", 5, "")
    assert "y  [" in cli.show_tree(spark, str(out), "", 3, 5, "", None)
    assert user in cli.show_reports(spark, [str(out / "r.json")], None, "growth")
    second = report | {"date": report["date"] + 200_000}
    sinks.write_json(second, str(out / "r2.json"))
    assert "trend" in cli.show_reports(spark, [str(out / "r.json"), str(out / "r2.json")], None, "growth")
    sinks.export_users(spark.createDataFrame([("dir", "a b", "/p", 5), ("file", "a b", "/p/q", 7)], "kind string, username string, path string, size long"), str(out / "export"))
    assert (out / "export/kind=file/user=a_b").is_dir()


def test_documents(tmp_path):
    assert documents.load_json(str(tmp_path / "none")) == {}
    (tmp_path / "bad.json").write_text("{")
    assert documents.load_json(str(tmp_path / "bad.json")) == {}
    assert documents.expand([f"{tmp_path}/*.json {tmp_path}/x"]) == [f"{tmp_path}/bad.json", f"{tmp_path}/x"]
    assert sinks.compact_json({"a": [{"b": 1, "c": 2}]}) == '{\n    "a": [\n        { "b": 1, "c": 2 }\n    ]\n}'
    assert documents.capacity("/nowhere")["total"] == 0


def test_streaming_adds_up(spark, files, tmp_path):
    source, sums = str(tmp_path / "events"), str(tmp_path / "sums")
    for _ in range(2):
        files.write.mode("append").parquet(source)
        incremental.follow(spark, source, sums, str(tmp_path / "cp")).awaitTermination()
    assert {r.path: r.total_size for r in incremental.subtree_sums(spark, sums).collect()}["/"] == 2 * 15872


def test_issue_search(spark):
    rows = issues.numbered(spark.createDataFrame([(1, "u", "file", "EIO", "/a/1"), (1, "u", "file", "EIO", "/b/2"), (2, "v", "file", "EIO", "/a/3")], "uid long, user string, item_type string, error string, path string"))
    assert [(r.id, r.total) for r in issues.of_user(rows, "u", 1, "/").collect()] == [(1, 2)]


def test_card_and_copies(tmp_path):
    report = {"directory": "/d", "general_system": {"total": 4096, "used": 1024}, "team_usage": [{"name": "lab", "used": 9}], "user_usage": [{"name": f"u{i}", "used": i} for i in range(14)], "other_usage": []}
    body = notify.card(report)["attachments"][0]["content"]["body"]
    assert [f["title"] for f in body[-1]["facts"]] == [f"u{i}" for i in range(13, 3, -1)]
    assert not notify.send("http://127.0.0.1:9/none", report, 0.2)
    seen = []
    target = sync.Target("host", "/srv/re ports/", "me", lambda args, **k: seen.append(args) or 0)
    (tmp_path / "r.json").write_text("{}")
    assert target.push_folder(str(tmp_path)) and target.push_file(str(tmp_path / "r.json"))
    assert "'/srv/re ports.staging'" in seen[0][2].replace("'\"'\"'", "'") and seen[1][-2] == "me@host" and seen[2][-1].endswith("'/srv/re ports/r.json'")
    failing = sync.Target("host", "/srv", run=lambda args, **k: 1)
    assert not failing.push_folder(str(tmp_path))


def test_the_tree_begins_at_the_scan_root(spark):
    dirs = ["/top/data/b/c", "/top/data/a", "/top/data/a-b/z", "/top/other/x", "/top/data2"]
    rows = tree.numbered(tree.closure(spark.createDataFrame([(d,) for d in dirs], "dir string"), "/top/data"), "/top/data").orderBy("dir_id").collect()
    assert [(r.dir_id, r.parent_id, r.depth, r.path, r.name) for r in rows] == [
        (0, None, 0, "/top/data", "data"), (1, 0, 1, "/top/data/a", "a"), (2, 0, 1, "/top/data/a-b", "a-b"), (3, 0, 1, "/top/data/b", "b"), (4, 2, 2, "/top/data/a-b/z", "z"), (5, 3, 2, "/top/data/b/c", "c"),
    ]
    assert [r.name_id for r in rows] == [0, 1, 2, 3, 4, 5]
    direct = spark.createDataFrame([(d, 1, 10, 1) for d in dirs], "dir string, uid long, size long, files long")
    sums = {r.path: r.total_size for r in tree.subtree_usage(direct, "/top/data", 3).collect()}
    assert sums == {"/top/data": 30, "/top/data/a": 10, "/top/data/a-b": 10, "/top/data/b": 10}


@pytest.mark.parametrize("level", [1, 2, 3])
def test_treemap_levels_under_a_deep_root(spark, tmp_path, level):
    root, out = tmp_path / "a/b/data", tmp_path / "out"
    (root / "x/y/z/deep").mkdir(parents=True)
    out.mkdir()
    (root / "x/y/z/deep/f").write_bytes(b"z" * 9000)
    (root / "x/empty").write_bytes(b"")
    config = Config(str(tmp_path / "c.json"))
    config.init(str(root))
    report = cli.run(spark, config.data, str(out), str(out / "r.json"), level=level)
    t = sinks.read_tables(spark, str(out), cli.TABLES)
    shown = {r.path.removeprefix(str(root)): (r.dir_id, r.total_size) for r in t["treemap"].collect()}
    used = (root / "x/y/z/deep/f").stat().st_blocks * 512
    want = ["", "/x", "/x/y", "/x/y/z", "/x/y/z/deep"][: level + 1]
    assert shown == {p: (i, used) for i, p in enumerate(want)}
    assert {r.path.removeprefix(str(root)) for r in t["dirs"].collect()} == {"/x/y/z/deep"}
    assert "x  [" in cli.show_tree(spark, str(out), "", level, 5, "", None)
    text = cli.run_summary(report, [str(out / "r.json")])
    assert "2 files, 5 directories" in text and "r.json  (" in text and "Other" in text


def test_tables_are_switched_at_once(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    first = sinks.write_tables({"users": one, "dirs": one}, str(tmp_path))
    with pytest.raises(ValueError, match="broken"):
        sinks.write_tables({"users": two, "files": type("Broken", (), {"write": property(lambda _: (_ for _ in ()).throw(ValueError("broken")))})()}, str(tmp_path))
    assert sinks.tables_folder(str(tmp_path)) == first
    assert sinks.read_tables(spark, str(tmp_path), ["users", "dirs", "none"])["users"].count() == 3
    second = sinks.write_tables({"users": two}, str(tmp_path))
    assert [p.name for p in tmp_path.glob("tables-*")] == [os.path.basename(second)]
    assert set(sinks.read_tables(spark, str(tmp_path), ["users", "dirs"])) == {"users"}
    assert sinks.find_tables(str(tmp_path / "x/y")) == str(tmp_path)


def test_rows_are_numbered_by_ranges(spark):
    names = [f"part-{i:05d}" for i in range(3000)] + ["a", "zz", "é"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = {r.name: r.n for r in numbering.numbered_by(rows, "n", "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=str.encode))}
    assert numbering.numbered_by(rows.limit(0), "n", "name").count() == 0


MOUNTS = ["21 1 8:1 / / rw", "22 21 8:2 / /data rw", "23 22 8:2 / /data/mirror rw", "24 22 8:3 /x /mnt/x rw", "25 22 8:3 /x /data/x rw", "26 22 8:4 /y /data/y rw", "27 22 8:4 /y /data/y2 rw", "28 21 8:4 /y /other rw", "29 x"]


def test_mounts_met_before(spark):
    lines = spark.createDataFrame(list(enumerate(MOUNTS)), "line_no long, value string")
    assert sorted(r[0] for r in mounts.duplicate_mounts(lines, "/data/").collect()) == ["/data/mirror", "/data/y2"]


def test_names_in_both_lists_and_gaps(spark):
    rows = spark.createDataFrame([(1, "user", "a", 5), (1, "other", "a", 9), (2, "user", "a", 0), (2, "other", "a", 7), (1, "other", "b", 3)], "day long, source string, name string, used long")
    assert sorted(map(tuple, compare.series(rows).select("day", "name", "used").collect())) == [(1, "a", 5), (1, "b", 3), (2, "a", 7), (2, "b", 0)]


def test_interface():
    import tallystone

    assert all(getattr(tallystone, name) is not None for name in tallystone.__all__)
    assert tallystone.owner_of("/nowhere") is None and tallystone.owner_of("/") == "root" and tallystone.username_of(4_000_000) == "uid-4000000"
    assert tallystone.bar(50, 4) == "[##--]" and tallystone.time_text(None) == "" and tallystone.time_text(0, "%Y") in ("1969", "1970")


def test_reports_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    assert cli.show_reports(spark, [str(tmp_path / "bad.json"), str(tmp_path / "none.json")], None, "growth") == f"No report: {tmp_path}/bad.json\nNot found: {tmp_path}/none.json"


def test_progress():
    p = status.Progress(begin=100.0)
    p.enter("sync", "copying")
    seen = p.document(now=90)
    assert seen["stage"] == "sync" and seen["total_elapsed_sec"] == 0 and seen["running"] and seen["finished_at"] == 0
    with pytest.raises(ValueError, match="phase"):
        p.enter("nothing")


def test_copies_fall_back_without_a_compressor(tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(sync.shutil, "which", lambda name: name)

    def run(args, **_):
        seen.append(" ".join(args))
        return 1 if "zstd -q -d" in seen[-1] else 0

    assert sync.Target("host", "/srv/r", run=run, password="secret").push_folder(str(tmp_path), compress=True)
    assert any("command -v zstd" in c for c in seen) and not any("secret" in c for c in seen)
    assert sum("tar -C" in c for c in seen) == 2 and seen[-1].startswith("sshpass -e ssh")
