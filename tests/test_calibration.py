"""Moments rolled from days are those of all rows at once; runs are found by their manifest."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions import scalars as s
from barlattice.operators import calibration as cal
from barlattice.operators import evaluation as e
from barlattice.operators import windows as w
from barlattice.sources import adapters as a

COLUMNS = "code string, trade_date date, rps double, ret20 double, volume_ratio_prev double, atr14 double, close double, inflow_days int, ma5 double, ma10 double, ma20 double, prior_n int, prior_high20 double, fwd_ret5 double, fwd_ret10 double"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    some = lambda lo, hi: rnd.choice([None, rnd.uniform(lo, hi), rnd.uniform(lo, hi)])
    made = [(f"{c:06d}", dt.date(2024, 1, 1) + dt.timedelta(days=k), some(0, 100), some(-0.3, 0.3), some(0, 6), some(0, 2), rnd.uniform(5, 20), rnd.randint(0, 6), *(rnd.uniform(5, 20) for _ in range(3)), rnd.choice([20, 20, 9]), rnd.uniform(5, 20), some(-0.2, 0.3), some(-0.2, 0.3)) for c in range(12) for k in range(80)]
    return spark.createDataFrame(made, COLUMNS).repartition(4).cache()


def plain(df):
    return {(r["horizon"], r["feature"], r["bin"]): (r["n"], r["ups"], r["mean"], r["sd"], r["ci_low"], r["ci_high"]) for r in df.collect()}


def near(got, want):
    assert got.keys() == want.keys() and got
    for k, v in want.items():
        assert all(a == b or a == pytest.approx(b, abs=1e-9) for a, b in zip(got[k], v, strict=True)), (k, got[k], v)


def test_moments_are_those_of_single_rows(rows):
    near(plain(cal.stats(cal.binned_moments(rows))), plain(e.bin_stats(e.observations(rows), "horizon", "feature", "bin")))


def test_rolling_over_days_kept_in_several_goes(spark, rows, tmp_path):
    path = f"file://{tmp_path}/c"
    assert cal.load_latest(spark, path) is None and cal.last_day(spark, path) is None
    day = F.col("trade_date")
    early = rows.where(day < "2024-02-15").withColumn("fwd_ret10", F.when(day < "2024-02-05", F.col("fwd_ret10")))
    cal.extend(spark, path, early)
    assert str(cal.last_day(spark, path)) == "2024-02-04"
    before = cal.tables(spark, path)[0].manifest(1)["parts"]
    cal.extend(spark, path, rows.where(day >= "2024-02-05"))
    now = cal.tables(spark, path)[0].manifest(2)["parts"]
    assert before["2024-01"] == now["2024-01"] and before["2024-02"] != now["2024-02"]
    cal.roll(spark, path, "a", "2024-03-01", 10)
    got = plain(cal.roll(spark, path, "b", "2024-03-10", 45))
    near(got, plain(e.bin_stats(e.observations(rows.where((day > "2024-01-25") & (day <= "2024-03-10"))), "horizon", "feature", "bin")))
    near(plain(cal.load_latest(spark, path)), got)
    cal.extend(spark, path, rows.where(day >= "2024-03-01").withColumn("fwd_ret5", F.lit(9.0)))  # a run keeps the version that it read
    near(plain(cal.load_latest(spark, path)), got)
    assert [(r["run"], r["version"]) for r in cal.tables(spark, path)[1].read().orderBy("run").collect()] == [("a", 2), ("b", 2)]


def test_running_counts_give_the_features_of_frames(spark):
    rnd = random.Random(9)
    some = lambda: rnd.choice([None, *(rnd.uniform(5, 20) for _ in range(9))])
    made = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=k), some(), some(), some() if c < 3 else 7.0, some(), some()) for c, n in enumerate((1, 12, 25, 90, 200)) for k in range(n)]
    bars = spark.createDataFrame(made, "code long, trade_date date, high double, low double, close double, volume double, amount double").cache()
    names = ["ma5", "ma10", "ma20", "ma60", "prior_n", "volume_ratio_incl", "volume_ratio_prev", "volume_ratio10", "amount_ratio5", "volume_mean10", "fwd_ret5", "fwd_ret10", "n"]
    more = lambda ran: {f"fwd_ret{h}": w.forward(h, ran)[f"fwd_ret{h}"] for h in (5, 10)} | {"n": w.streak_of(F.col("close") > 9, "rn")}
    got, want = (sorted(map(tuple, w.features(bars, more(ran), ran).select("code", "trade_date", *names).collect())) for ran in (True, False))
    assert got == want and all(any(row[i] is not None for row in got) for i in range(len(names) + 2))
    streaks = w.streak(bars, F.col("close") > 9, "n").select("code", "trade_date", "n").collect()
    assert sorted((r[0], r[1], r[-1]) for r in got) == sorted(map(tuple, streaks))


def test_marks_hold_every_bin(spark, rows):
    feats = e.binned_features()
    marked = e.marked(rows)
    plain_bins = marked.select("*", *[e.bin_of(c, e.BINS[k]).alias(f"b_{k}") for k, c in feats.items()]).select("*", *[c.alias(f"m_{k}") for k, c in e.labels(e.ranked_marks()).items()])
    assert plain_bins.where(" OR ".join(f"NOT (b_{k} <=> m_{k})" for k in feats)).count() == 0
    assert max(len(e.BINS[k]) for k in feats) < 1 << e.BITS


def test_code_numbers_are_those_of_texts(spark):
    keys = [0, 7, 999, 123456, 999999, 1000000, 1000007, 98765432101, -5, -99999, -123456, -1234567, None]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(a.code_text(F.col("k")).alias("text"), a.code_number(F.col("k")).alias("number")).withColumn("again", a.code_text(F.col("number"))).collect()
    assert all(r["text"] == r["again"] for r in got)
    assert len({r["text"] for r in got}) == len({r["number"] for r in got})


def test_a_rank_in_one_pass_is_the_average_rank(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.randrange(4), rnd.choice([0.0, -0.0, float("nan"), rnd.random(), 0.5])) for _ in range(400)], "day int, v double")
    day = Window.partitionBy("day")
    both = df.select(s.average_rank_in(F.col("v"), day.orderBy("v")).alias("x"), s.average_rank(F.col("v"), day, day.orderBy("v"), Window.partitionBy("day", "v")).alias("y")).collect()
    assert len(both) == 400 and all(r["x"] == r["y"] for r in both)
