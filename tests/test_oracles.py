"""Every query with SQL gives the rows of that SQL, and all queries run, on the smallest tables."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
CORE = {n: f for m in entry.MODULES if ".llm" not in m.__name__ for n, f in m.QUERIES.items()}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in CORE}


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    mine = CORE[name](spark, str(FOLDER))
    theirs = duck.execute(SQL[name]).fetch_df() if hasattr(duck, "fetch_df") else duck.execute(SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in mine.collect())
    assert rows == sorted(tuple(plain(x) for x in r) for r in theirs[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    assert CORE[name](spark, str(FOLDER)).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
