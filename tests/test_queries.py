"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from barlattice.plans import evaluation, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if v.isoformat().endswith("00:00:00") else v.isoformat()
    return float(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_spark_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, got = ordered(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    names, want = ordered([c[0] for c in cursor.description], cursor.fetchall())
    assert columns == names and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_a_row_per_grid_point(spark, name):
    """Their values are checked in test_backtest.py; on these tables every grid point with a signal has one row."""
    rows = QUERIES[name](spark, SF).collect()
    grids = [r["grid"] for r in rows]
    assert len(grids) == len(set(grids)) and set(grids) <= {f"temp{t}_rps{s}_hold{h}" for t, s, h in evaluation.GRID + evaluation.USUAL_GRID + evaluation.PLAN_GRID}
    assert all(r["trades"] >= 0 for r in rows if "trades" in r)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["code", "trade_date", "ret20", "rps"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
