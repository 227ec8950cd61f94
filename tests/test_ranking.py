"""Places, running totals and ranks over all rows equal a plain sort; ties may be long and ranges many."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from barlattice.operators import ranking

ROWS = [(k, random.Random(k).choice([None, 1, 1, 1, 1, 2, 5, 9]), random.Random(-k).randint(0, 5)) for k in range(3000)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, key int, n int").repartition(7)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_places_are_those_of_a_sort(table, ranges):
    got = ranking.numbered(table, [F.desc("key"), F.asc("id")], ranges=ranges).collect()
    want = sorted(ROWS, key=lambda r: (-(r[1] or -1), r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r[0] for r in want]
    assert sorted(r["place"] for r in got) == list(range(1, len(ROWS) + 1))


def test_long_ties_are_dealt_to_several_ranges(table):
    at = ranking.dealt(table.where("key = 1"), [F.asc("key")], 64)
    most = max(r["count"] for r in at.groupBy(F.shiftright("_at", ranking.ROWS)).count().collect())
    assert most < len([r for r in ROWS if r[1] == 1]) / 8
    assert "SinglePartition" not in ranking.numbered(table, [F.asc("key")])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 64])
def test_running_totals(table, ranges):
    got = {r["id"]: r["before"] for r in ranking.running_total(table, [F.asc("id")], "n", ranges=ranges).collect()}
    assert got == dict(zip([r[0] for r in ROWS], itertools.accumulate([0] + [r[2] for r in ROWS[:-1]]), strict=True))


def test_ranks_and_percentiles_of_ties(table):
    keys = sorted(r[1] for r in ROWS if r[1] is not None)
    for r in ranking.ranked(table, "key", 64).withColumn("p", ranking.percentile(F.col("rank"), F.col("ties"), F.col("of"))).collect():
        if r["key"] is None:
            assert r["rank"] is None and r["p"] is None
        else:
            low, ties = keys.index(r["key"]) + 1, keys.count(r["key"])
            assert (r["rank"], r["ties"], r["of"]) == (low, ties, len(keys)) and r["p"] == pytest.approx((low + (ties - 1) / 2) / len(keys) * 100)


def test_empty_table(table):
    none = table.where("id < 0")
    assert ranking.numbered(none, [F.asc("id")]).count() == 0 and ranking.running_total(none, [F.asc("id")], "n").count() == 0 and ranking.ranked(none, "key").count() == 0
