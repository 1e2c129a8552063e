"""Core operators against their SQL on the smallest tables, and edge cases."""

import importlib.util
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from verify import norm

CORE = {k: f for k, f in entry.queries().items() if not f.__module__.startswith("marlstone.llm")}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(k for k in CORE if k in SQL))
def test_equals_sql(spark, sf, con, name):
    df = CORE[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in CORE if k not in SQL))
def test_runs(spark, sf, name):
    df = CORE[name](spark, sf)
    assert df.columns and all(len(r) == len(df.columns) for r in df.collect())


def test_core_does_not_need_llm():
    assert importlib.util.find_spec("marlstone") is not None
    for root, _, files in os.walk(os.path.dirname(importlib.util.find_spec("marlstone").origin)):
        if os.path.basename(root) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "marlstone.llm" not in open(os.path.join(root, f)).read(), f
    assert F is not None
