import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice import config
from barlattice.functions import scalars as s


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("1.5亿", 1.5e8), ("-2,300万", -2.3e7), ("12元", 12.0), ("+7", 7.0), ("bad", 0.0), ("3亿元", 3e8)])
def test_amounts(spark, text, want):
    assert one(spark, s.amount_text(F.col("t")), t=text) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [("6天5板", 5), ("3板", 3), ("none", None)])
def test_streaks(spark, text, want):
    assert one(spark, s.streak_text(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("sh600000", "600000"), ("1", "000001"), ("12345678", "123456"), ("abcdefgh", "abcdefgh")])
def test_codes(spark, text, want):
    assert one(spark, s.code6(F.col("t")), t=text) == want


def test_numbers_venues_and_hashes(spark):
    assert one(spark, s.number(F.col("t")), t="abc") is None and one(spark, s.number(F.col("t")), t="nan") is None and one(spark, s.safe_number(F.col("t"), 3.0), t="x") == 3.0
    assert one(spark, s.percent_text(F.col("t")), t=" 12.5%") == 12.5
    assert [one(spark, s.venue(F.col("t")), t=c) for c in ("688001", "300001", "830001", "600000", "000001", "900001")] == ["star", "growth", "north", "main_sh", "main_sz", "other"]
    assert [one(spark, s.market_prefix(F.col("t")), t=c) for c in ("600000", "830001", "000001")] == ["sh", "bj", "sz"]
    assert len(one(spark, s.content_hash(F.col("t")), t=" a b ")) == 16


@pytest.mark.parametrize(("x", "want"), [(10.0, 0.0), (15.0, 0.0), (27.5, 25.0), (40.0, 50.0), (60.0, 67.5), (80.0, 85.0), (100.0, 92.5), (500.0, 100.0)])
def test_anchors(spark, x, want):
    assert one(spark, s.anchor_score(F.col("v"), 15, 40, 80, 120), v=x) == pytest.approx(want)


def test_intervals_and_sets(spark):
    low, high = s.wilson(F.col("u"), F.col("n"))
    assert one(spark, low, u=5, n=10) == pytest.approx(0.2366, abs=1e-3) and one(spark, high, u=5, n=10) == pytest.approx(0.7634, abs=1e-3)
    assert one(spark, low, u=0, n=0) == 0.0 and one(spark, high, u=0, n=0) == 1.0
    assert one(spark, s.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, s.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0.0
    assert one(spark, s.clamp(F.lit(None).cast("double"))) is None


def test_average_rank_is_pandas_rank(spark):
    from pyspark.sql import Window

    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    w = Window.partitionBy()
    got = [r["p"] for r in df.select("k", s.average_rank(F.col("v"), w, w.orderBy("v"), Window.partitionBy("v")).alias("p")).orderBy("k").collect()]
    assert got == pytest.approx(list(pd.Series(values).rank(pct=True) * 100))


def test_settings():
    assert config.settings(rps_min=70).rps_min == 70
    with pytest.raises(ValueError):
        config.settings(other=1)
    with pytest.raises(ValueError):
        config.settings(rps_min="x")
