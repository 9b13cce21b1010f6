"""The driver's entry points."""

import ast
from pathlib import Path

import duckdb

import __spark_entry__
from tallystone import queries

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_core_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES) and len(queries.QUERIES) > 70
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "tallystone").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_flagship_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(f"SELECT section, name, used, team_id FROM ({queries.ORACLES['rq1_usage_summary']})").fetchall()
    got = __spark_entry__.entry(spark).select("section", "name", "used", "team_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
