import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.operators import evaluation, market, rules, scans, windows
from barlattice.sources import quality
from barlattice.streaming import rollup

BARS = "code string, trade_date date, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module")
def rising(spark):
    """30 days of a slow rise, the last with 2.5 times the volume."""
    rows, close = [], 10.0
    for i in range(30):
        close += 0.15 + 0.02 * (i % 3)
        rows.append(("000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), close - 0.1, close + 0.1, close - 0.2, close, 25000.0 if i == 29 else 10000.0 + 50 * i, close * 1e4))
    return spark.createDataFrame(rows, BARS), pd.DataFrame(rows, columns=[c.split()[0] for c in BARS.split(", ")])


def test_windows_are_those_of_pandas(rising):
    df, p = rising
    last = windows.features(df).orderBy(F.desc("trade_date")).first()
    assert last["ma20"] == pytest.approx(p["close"].rolling(20).mean().iloc[-1])
    assert last["ret20"] == pytest.approx(p["close"].iloc[-1] / p["close"].iloc[-21] - 1)
    assert last["volume_ratio_prev"] == pytest.approx(p["volume"].iloc[-1] / p["volume"].iloc[-6:-1].mean())
    assert last["prior_high20"] == pytest.approx(p["close"].iloc[-21:-1].max())
    tr = pd.concat([p["high"] - p["low"], (p["high"] - p["close"].shift()).abs(), (p["low"] - p["close"].shift()).abs()], axis=1).max(axis=1)
    assert last["atr14"] == pytest.approx(tr.tail(14).mean())
    m = scans.macd(df).first()
    dif = p["close"].ewm(span=12, adjust=False).mean() - p["close"].ewm(span=26, adjust=False).mean()
    dea = dif.ewm(span=9, adjust=False).mean()
    assert (m["dif"], m["dea"], m["hist"]) == pytest.approx((dif.iloc[-1], dea.iloc[-1], 2 * (dif.iloc[-1] - dea.iloc[-1])))


def test_short_histories_give_nulls(rising):
    df, _ = rising
    rows = windows.features(df).orderBy("trade_date").collect()
    assert rows[3]["ma5"] is None and rows[4]["ma5"] is not None and rows[19]["ret20"] is None and rows[13]["atr14"] is None


def test_volume_pattern_and_plan(rising):
    df, _ = rising
    last = windows.features(df).orderBy(F.desc("trade_date")).limit(1).withColumn("turnover_rate", F.lit(5.0))
    out = rules.derive(last, [*rules.volume_audit(), *rules.entry_exit()]).first()
    assert out["volume_pattern"] == "breakout_with_volume" and out["volume_status"] == "ok"
    assert out["stop"] <= out["entry"] * 0.985 + 1e-9 and out["target1"] == pytest.approx(out["entry"] + 2 * out["risk"]) and out["entry_style"] == "ma_pullback"


def test_position_sizes(spark):
    df = spark.createDataFrame([(10.0, 0.5, 1.0), (10.0, 0.5, 0.0), (1.0, 50.0, 1.0)], "entry double, risk double, emotion double")
    assert [r["shares"] for r in rules.derive(df, rules.position()).collect()] == [2000.0, 0.0, 5000.0]


def test_phase_order(spark):
    rows = [(30.0, 50, 0, 2, 0.1, 60, 40, None), (90.0, 50, 0, 2, 0.5, 60, 40, None), (90.0, 50, 0, 2, 0.1, 60, 40, None), (50.0, 30, 5, 2, 0.1, 60, 40, -3.0), (70.0, 50, 5, 5, 0.1, 60, 40, None), (50.0, 30, 5, 2, 0.1, 60, 40, None), (50.0, 16, 5, 2, 0.1, 60, 40, None)]
    df = spark.createDataFrame(rows, "temperature double, limit_up long, limit_down long, max_streak long, broke_rate double, advance long, decline long, feedback double")
    assert [r["phase"] for r in market.phase(df).collect()] == ["ice", "divergence", "climax", "ebb", "main_rise", "repair", "divergence"]
    assert set(market.PHASES) == {"ice", "divergence", "climax", "ebb", "main_rise", "repair"}


def test_ledger_average_cost(spark):
    rows = [("a", 1, True, 100.0, 10.0), ("a", 2, True, 100.0, 12.0), ("a", 3, False, 50.0, 13.0), ("a", 4, False, 500.0, 10.0)]
    out = evaluation.ledger(spark.createDataFrame(rows, "code string, seq long, buy boolean, qty double, price double")).first()
    assert (out["shares"], out["cost"], out["realised"]) == pytest.approx((0.0, 11.0, 50 * 2 - 150))


def test_backtest_stops_and_costs(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    bars = [("a", day(k), c, c, c, c, 1.0, 1.0) for k, c in enumerate([10.0, 10.0, 10.0, 5.0, 5.0, 5.0])]
    b = spark.createDataFrame(bars, BARS)
    s = spark.createDataFrame([("a", day(0), 1.0)], "code string, trade_date date, score double")
    paths = evaluation.trade_paths(s, b, 4).selectExpr("'g' AS grid", "code", "trade_date", "score", "9.0D AS stop", "13.0D AS target", "4 AS hold", "path")
    out = evaluation.backtest(paths, cash=10_000.0, slots=1).first()
    assert out["trades"] == 1 and out["wins"] == 0 and out["final_equity"] == pytest.approx(10_000 - 900 * 10.01 * 1.0003 + 900 * 5 * 0.999 * (1 - 0.0013), rel=1e-6)


def test_event_pool(spark):
    dragon = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", -1.0)], "code string, net double")
    spot = spark.createDataFrame([("c", 6.0), ("d", 7.0), ("e", 1.0), ("f", 9.0)], "code string, pct_change double")
    told = spark.createDataFrame([("c", "old", 1), ("c", "big order", 2), ("d", "loss", 1), ("e", "order", 1)], "code string, title string, ts long")
    assert dict(map(tuple, rules.event_pool(dragon, spot, told, "loss", "order").collect())) == {"a": 75.0, "b": 70.0, "c": 72.0, "d": 40.0}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k long, v string")
    q = quality.assess(df, ["v"]).first()
    assert (q["row_count"], q["n_v"], q["missing_v"], q["status"]) == (2, 1, 0.5, "degraded")
    assert quality.assess(df.limit(0), ["v"]).first()["status"] == "failed"

    def broken():
        raise RuntimeError("no network")

    got, chain = quality.first_available([("a", broken), ("b", lambda: df.limit(0)), ("c", lambda: df)])
    assert got.count() == 2 and [c["status"] for c in chain] == ["failed", "empty", "ok"]
    assert quality.by_priority([df.where("k = 1"), df.withColumn("v", F.lit("y"))], ["k"]).where("k = 1").first()["v"] is None
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "trade_date date, x long")
    root = str(tmp_path)
    assert quality.write_snapshot({"t": days, "bad": df}, root)["t"] == "ok"
    assert quality.write_snapshot({"t": days.where("x = 2").withColumn("x", F.lit(3).cast("long"))}, root) == {"t": "ok"}
    assert [r["x"] for r in quality.read_snapshot(spark, root, "t", "2024-01-05").collect()] == [3]
    assert quality.read_snapshot(spark, root, "t", "2024-01-05", "snapshot").count() == 0 and quality.read_snapshot(spark, root, "t", "2024-01-01", "snapshot").count() == 1
    lines = spark.createDataFrame([("n~600000~10.5~3~2",), ("short~1",), ("n~1~bad~x~1",)], "value string")
    assert [tuple(r) for r in quality.parse_quote_lines(lines).collect()] == [("n", "600000", 10.5, 300.0, 20000.0), ("n", "1", None, None, 10000.0)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (None, "m"), (3, "d")], "k long, v string")
    assert sorted(map(str, (tuple(r) for r in evaluation.upsert(old, new, ["k"]).collect()))) == sorted(map(str, [(1, "a"), (2, "c"), (None, "m"), (3, "d")]))


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rollup.rollup(stream, "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6), r["open"], r["close"]) for r in rows)
    assert key(spark.table("bars_out").collect()) == key(rollup.rollup(events, "1 day").collect())
    assert rollup.sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == events.count()
