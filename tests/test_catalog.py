"""Registered queries beside their SQL on the smallest tables, and the entry's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fathom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def flat(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(flat, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(flat, r)) for r in df.select(*columns).collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(flat(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry_and_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_flagship_plan_joins_content_last(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank", "head"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "RDD" not in plan


def test_nothing_but_the_subpackage_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/fathom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "fathom.llm" not in open(path).read(), path
