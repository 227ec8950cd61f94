"""Scans of keys whose rows lie in one range or in many equal a plain loop, and keep no rows."""

import random
import resource

import pytest
from pyspark.sql import functions as F

from barlattice.operators import evaluation, scans


def plain_macd(closes):
    f = s = closes[0]
    g = 0.0
    for x in closes:
        f, s = f * (1 - 2 / 13) + x * 2 / 13, s * (1 - 2 / 27) + x * 2 / 27
        g = g * 0.8 + (f - s) * 0.2
    return f - s, g, (f - s - g) * 2


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_means_of_a_key_in_many_ranges(spark, ranges):
    rnd = random.Random(1)
    series = {c: [rnd.uniform(5, 50) for _ in range(n)] for c, n in (("a", 1), ("b", 900), ("c", 40), ("d", 2))}
    rows = [(c, k, x) for c, xs in series.items() for k, x in enumerate(xs)] + [("b", 5000, None)]
    df = spark.createDataFrame(rows, "code string, day int, close double").withColumn("trade_date", F.expr("date_add(DATE '2020-01-01', day)")).repartition(5)
    got = {r["code"]: (r["dif"], r["dea"], r["hist"]) for r in scans.macd(df, ranges=ranges).collect()}
    assert got.keys() == series.keys()
    for c, xs in series.items():
        assert got[c] == pytest.approx(plain_macd(xs), abs=1e-9)
    assert scans.macd(df.where("code = 'x'")).count() == 0


def test_a_long_history_is_streamed(spark):
    """Two million trades of one code: the worker's memory after the last is that after the first ten thousand, give or take some MB."""
    n = 2_000_000
    trades = spark.range(n).select(F.lit("a").alias("code"), F.col("id").alias("seq"), (F.col("id") % 3 < 2).alias("buy"), F.lit(10.0).alias("qty"), (F.lit(5.0) + F.col("id") % 7).alias("price"))

    def watched(state, row):
        seen = state[3:]
        if row[0] in (10_000, n - 1):
            seen = (*seen[1:], float(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss))
        return (*evaluation.booked(state[:3], row), *seen)

    got = scans.streamed(trades, "code", ["seq"], (0.0, 0.0, 0.0, 0.0, 0.0), watched, "code string, shares double, cost double, realised double, early double, late double").collect()
    state = (0.0, 0.0, 0.0)
    for k in range(n):
        state = evaluation.booked(state, (k, k % 3 < 2, 10.0, 5.0 + k % 7))
    assert [tuple(r)[:4] for r in got] == [("a", *state)]
    assert 0 < got[0]["late"] - got[0]["early"] + 1 < 30_000


def test_ledger_edges(spark):
    rows = [("a", 1, False, 5.0, 9.0), ("a", 2, True, 10.0, 1.0005), ("a", 3, False, 20.0, 2.0), ("b", 1, True, 1.0, 3.0)]
    got = sorted(map(tuple, evaluation.ledger(spark.createDataFrame(rows, "code string, seq long, buy boolean, qty double, price double")).collect()))
    assert got == [("a", 0.0, 1.001, pytest.approx(9.99)), ("b", 1.0, 3.0, 0.0)]


@pytest.mark.parametrize("range_rows", [100_000, 64, 7])
def test_percentiles_of_series_in_many_ranges(spark, range_rows):
    rnd = random.Random(4)
    rows = [(s, k, rnd.choice([None, 1.0, 2.0, rnd.uniform(0, 9)])) for s in ("x", "y", "z") for k in range(90 if s != "z" else 3)]
    got = scans.prior_percentiles(spark.createDataFrame(rows, "s string, k int, v double").repartition(4), "s", "k", "v", (10, 25), range_rows=range_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        for n in (10, 25):
            past = [v for s, k, v in rows if s == r["s"] and r["k"] - n <= k < r["k"] and v is not None]
            want = None if r["v"] is None or len(past) < 5 else sum(v < r["v"] for v in past) / len(past) * 100
            assert r[f"pct{n}"] == (None if want is None else pytest.approx(want, abs=0.051))
