"""Every query with SQL against the same SQL in another engine, over the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    r = con.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert Counter(tuple(map(norm, x)) for x in df.collect()) == Counter(tuple(norm(x[i]) for i in order) for x in r.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"stay_id", "timestep", "event_flag"} <= set(df.columns)
