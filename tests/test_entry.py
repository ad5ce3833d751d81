"""Driver contract: every query runs, and agrees with its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("PIXLOOM_SMOKE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("p")] + ["p4_found"])
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(plain(tuple(r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(repr(plain(tuple(r[i] for i in at))) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
