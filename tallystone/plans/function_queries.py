"""Scalar functions over fixture columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, paths
from ..registry import query
from .base import Scan

ODD = """odd AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url || '//' WHEN 2 THEN '/' WHEN 3 THEN '.hidden' WHEN 4 THEN '/top/' || CAST(page_id AS VARCHAR) || '.tar.GZ' ELSE 'dir.d/name.' END AS p FROM pages)"""


def odd_paths(spark, sf_dir):
    """Paths of many shapes."""
    pick = F.col("page_id") % 6
    p = F.when(pick == 0, F.col("url")).when(pick == 1, F.concat("url", F.lit("//"))).when(pick == 2, "/").when(pick == 3, ".hidden")
    p = p.when(pick == 4, F.concat(F.lit("/top/"), F.col("page_id").cast("string"), F.lit(".tar.GZ"))).otherwise("dir.d/name.")
    return Scan(spark, sf_dir).table("pages").select("page_id", p.alias("p"))


@query(
    "sc_path_parts",
    f"""WITH {ODD}, bare AS (SELECT *, regexp_replace(p, '/+$', '') AS b, regexp_replace(regexp_replace(p, '/+$', ''), '/[^/]*$', '') AS up FROM odd)
SELECT page_id, CASE WHEN NOT contains(b, '/') THEN NULL WHEN up = '' THEN '/' ELSE up END AS parent,
  CASE WHEN NOT contains(b, '/') THEN '/' WHEN up = '' THEN '/' ELSE up END AS parent_or_root,
  string_split(b, '/')[-1] AS base, CASE WHEN b = '' THEN '/' ELSE b END AS root,
  lower(regexp_extract(string_split(p, '/')[-1], '^.+\\.([^.]*)$', 1, 's')) AS ext,
  CAST(length(p) - length(replace(p, '/', '')) AS INTEGER) AS depth,
  regexp_replace(p, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM bare""",
)
def path_parts(spark, sf_dir):
    p = F.col("p")
    return odd_paths(spark, sf_dir).select(
        "page_id", paths.parent(p).alias("parent"), paths.parent_or_root(p).alias("parent_or_root"), paths.basename(p).alias("base"), paths.normalize_root(p).alias("root"),
        paths.extension(p).alias("ext"), paths.depth(p).alias("depth"), paths.safe_file_name(p).alias("safe"),
    )


@query("sc_sanitize", "SELECT page_id, regexp_replace(url || chr(7) || chr(9) || chr(127) || chr(133) || 'x', '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{9F}]', '�', 'g') AS clean FROM pages")
def sanitized(spark, sf_dir):
    dirty = F.concat("url", F.lit("\x07\t\x7f\x85x"))
    return Scan(spark, sf_dir).table("pages").select("page_id", paths.sanitize(dirty).alias("clean"))


@query(
    "sc_absolute_paths",
    """WITH p AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'data/' || s_name WHEN 2 THEN '/srv/data/' || s_name ELSE 'database/' || s_name END AS path FROM supplier)
SELECT id, CASE WHEN starts_with(path, '/') THEN path WHEN path = 'data' OR starts_with(path, 'data/') THEN '/srv/data' || substr(path, 5) ELSE '/srv/data/' || path END AS absolute,
  CASE WHEN path = '' THEN 'f' WHEN path = '/' THEN '/f' ELSE path || '/f' END AS joined, CAST(id % 3 AS BIGINT) AS bucket FROM p""",
)
def absolute_paths(spark, sf_dir):
    pick = F.col("s_suppkey") % 4
    path = F.when(pick == 0, F.lit("data")).when(pick == 1, F.concat(F.lit("data/"), "s_name")).when(pick == 2, F.concat(F.lit("/srv/data/"), "s_name")).otherwise(F.concat(F.lit("database/"), "s_name"))
    rows = Scan(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("id"), path.alias("path"))
    return rows.select("id", paths.absolute(F.col("path"), "/srv/data/").alias("absolute"), paths.join_path(F.col("path"), F.lit("f")).alias("joined"), paths.bucket(F.col("id")).cast("long").alias("bucket"))


SIZES = "sz AS (SELECT l_orderkey, l_linenumber, l_partkey, (CAST(round(l_extendedprice * 100) AS BIGINT) - 500000) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 997003 ELSE 9973 END AS size FROM lineitem)"
UNITS = {"TB": 1 << 40, "GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10}


def _text_sql(digits: list[int], negative: str) -> str:
    return f"CASE {negative} " + " ".join(f"WHEN size >= {v} THEN printf('%.{d}f', round_even(CAST(size AS DOUBLE) / {v}, {d})) || ' {k}'" for (k, v), d in zip(UNITS.items(), digits, strict=True)) + " ELSE CAST(size AS VARCHAR) || ' B' END"


@query(
    "sc_size_text",
    f"WITH {SIZES} SELECT l_orderkey, l_linenumber, l_partkey, size, {_text_sql([2, 1, 0, 0], "WHEN size < 0 THEN '0 B'")} AS shown, {_text_sql([2] * 4, '')} AS logged, {_text_sql([1] * 4, '')} AS summed FROM sz",
)
def size_texts(spark, sf_dir):
    pick = F.col("l_linenumber") % 4
    factor = F.when(pick == 0, 1).when(pick == 1, 997).when(pick == 2, 997003).otherwise(9973)
    size = (F.round(F.col("l_extendedprice") * 100).cast("long") - 500000) * factor
    rows = Scan(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", size.alias("size"))
    s = F.col("size")
    return rows.select("*", formats.size_text(s).alias("shown"), formats.size_text_digits(s, 2).alias("logged"), formats.size_text_digits(s, 1).alias("summed"))


@query(
    "sc_bars_and_times",
    """WITH o AS (SELECT o_orderkey, o_totalprice / 3000 - 5 AS pct, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS s, 1500000000 + o_orderkey * 86413 AS epoch FROM orders),
f AS (SELECT *, least(20, greatest(0, CAST(trunc(pct / 100 * 20) AS INTEGER))) AS n FROM o)
SELECT o_orderkey, '[' || repeat('#', n) || repeat('-', 20 - n) || ']' AS bar,
  CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration,
  strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d %H:%M:%S') AS at, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d') AS day,
  format('{:,}', epoch) AS grouped, pct / 200 * 100 AS share FROM f""",
)
def bars_and_times(spark, sf_dir):
    rows = Scan(spark, sf_dir).table("orders").select("o_orderkey", (F.col("o_totalprice") / 3000 - 5).alias("pct"), (F.floor("o_totalprice") % 9000).alias("s"), (F.lit(1500000000) + F.col("o_orderkey") * 86413).alias("epoch"))
    return rows.select(
        "o_orderkey", formats.usage_bar(F.col("pct")).alias("bar"), formats.duration_text(F.col("s")).alias("duration"), formats.timestamp_text(F.col("epoch")).alias("at"),
        formats.date_text(F.col("epoch")).alias("day"), formats.grouped_number(F.col("epoch")).alias("grouped"), formats.percent_of(F.col("pct"), F.lit(200)).alias("share"),
    )


@query(
    "sc_error_codes",
    """WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/a/b: Permission denied (os error 13)' WHEN 1 THEN '/x: No such file or directory' WHEN 2 THEN '/y: failed (os error 5)' WHEN 3 THEN 'nothing' WHEN 4 THEN '/z: q: permission denied' ELSE '/w: (os error 2)' END AS m FROM events)
SELECT event_id, CASE WHEN contains(m, 'os error 13') OR contains(m, 'Permission denied') OR contains(m, 'permission denied') THEN 'EACCES' WHEN contains(m, 'os error 2') OR contains(m, 'No such file') OR contains(m, 'no such file') THEN 'ENOENT' WHEN contains(m, 'os error 5') THEN 'EIO' ELSE 'EOTHER' END AS code,
  CASE WHEN contains(m, ': ') THEN string_split(m, ': ')[1] ELSE '' END AS path FROM m""",
)
def error_codes(spark, sf_dir):
    pick = F.col("event_id") % 6
    m = F.when(pick == 0, "/a/b: Permission denied (os error 13)").when(pick == 1, "/x: No such file or directory").when(pick == 2, "/y: failed (os error 5)").when(pick == 3, "nothing").when(pick == 4, "/z: q: permission denied").otherwise("/w: (os error 2)")
    rows = Scan(spark, sf_dir).table("events").select("event_id", m.alias("m"))
    return rows.select("event_id", formats.error_code(F.col("m")).alias("code"), formats.error_path(F.col("m")).alias("path"))
