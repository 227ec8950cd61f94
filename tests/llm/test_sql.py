"""The SQL of the training-text queries gives in DuckDB what Spark gives, on the smallest tables."""

import duckdb
import pytest

from barlattice.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_spark_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert want and sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == want


def test_shards_split_to_several_depths(spark):
    depths = {r[0] for r in queries.op2_sharding(spark, "/root/testdata/sf0.01").select("shard_depth").distinct().collect()}
    assert len(depths) > 1
