"""The sweep against a ledger in plain Python over DuckDB's features."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from barlattice.operators import evaluation as e
from barlattice.plans import evaluation, registry
from barlattice.plans.common import with_ctes
from barlattice.plans.market import TEMP


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """80 stocks a day, so eight signals a day at strength 90; prices of which some are too high for a lot."""
    root, rng, rows = tmp_path_factory.mktemp("crowded"), random.Random(7), []
    for code in range(1, 81):
        price = rng.choice([20.0, 60.0, 400.0, 1500.0])
        for day in range(60):
            price *= rng.choice([0.8, 0.9, 1.0, 1.1, 1.25]) if day % 9 else rng.choice([0.15, 1.0, 4.5])
            price = min(max(price, 2.0), 3000.0)
            for line in (1, 2):
                rows.append((day * 100 + code, code, code, line, 1.0, round(price * rng.uniform(0.9, 1.1), 2), "N", dt.datetime(2000, 1, 1) + dt.timedelta(days=day)))
    pd.DataFrame(rows, columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_returnflag l_shipdate".split()).astype({"l_shipdate": "datetime64[us]"}).to_parquet(root / "lineitem.parquet")
    return str(root)


def brute(sf_dir, strengths=(90, 95, 98)):
    """Per grid point: trades, wins, equity; each day's candidates are walked in order, every one of them."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    bars: dict = {}
    for code, day, o, c in con.execute(with_ctes("bars") + "SELECT code, trade_date, open, close FROM bars ORDER BY 1, 2").fetchall():
        bars.setdefault(code, []).append((day, o, c))
    at = {(code, b[0]): k for code, path in bars.items() for k, b in enumerate(path)}
    told = con.execute(with_ctes("rps", "ch", more=TEMP) + f"SELECT trade_date, code, rps, close, coalesce(temperature, 50) FROM rps LEFT JOIN tp USING (trade_date) WHERE rps >= {min(strengths)} AND atr14 IS NOT NULL ORDER BY trade_date, rps DESC, code").fetchall()
    out = {}
    for temp in (30, 40, 50):
        for least in strengths:
            for hold in (10, 20, 30):
                money, held, trades, wins, any_signal = 1e6, [], 0, 0, False
                for day, code, score, close, heat in told:
                    if score < least or heat < temp:
                        continue
                    path = bars[code][at[code, day] + 1 : at[code, day] + hold + 2]
                    if len(path) < 2:
                        continue
                    any_signal = True
                    money += sum(m for d, m in held if d <= day)
                    held = [(d, m) for d, m in held if d > day]
                    price = path[0][1] * 1.001
                    shares = int(min(1e5, money) / (price * 1.0003) // 100 * 100)
                    if len(held) >= 10 or shares <= 0:
                        continue
                    for k, (d, o, c) in enumerate(path[1:], start=2):
                        last = o if o <= close * 0.9 or o >= close * 1.3 or k == len(path) else c if c <= close * 0.9 or c >= close * 1.3 else None
                        if last is not None:
                            break
                    money -= shares * price * 1.0003
                    held.append((d, shares * last * 0.999 * (1 - 0.0013)))
                    trades, wins = trades + 1, wins + (last > price)
                if any_signal:
                    out[f"temp{temp}_rps{least}_hold{hold}"] = (trades, wins, money + sum(m for _, m in held))
    return out


@pytest.mark.parametrize("where", ["crowded", "/root/testdata/sf0.01"])
def test_sweep_is_the_ledger_of_all_signals(spark, request, where):
    sf_dir = request.getfixturevalue(where) if where == "crowded" else where
    got = {r["grid"]: (r["trades"], r["wins"], r["final_equity"]) for r in registry.queries()["backtest_sweep"](spark, sf_dir).collect()}
    want = brute(sf_dir)
    assert set(got) == set(want) and len(want) > 9
    for grid, (trades, wins, equity) in want.items():
        assert got[grid][:2] == (trades, wins), grid
        assert got[grid][2] == pytest.approx(equity, abs=0.02), grid
    assert len({got[g][0] for g in got if g.startswith("temp30") and g.endswith("hold10")}) == 3


def test_trade_log_and_equity_curve_by_hand(spark):
    """Two trades walked by hand: one meets its target at a close, one expires; the curve marks both at each day's close."""
    day = lambda k: dt.date(2024, 1, k)
    prices = {"a": [(2, 10.0, 10.0), (3, 10.0, 11.0), (4, 11.0, 14.0), (5, 15.0, 15.0), (8, 15.0, 15.0)], "b": [(2, 20.0, 20.0), (3, 20.0, 21.0), (5, 22.0, 22.0), (8, 21.0, 19.0)]}
    bars = spark.createDataFrame([(c, day(k), o, x) for c, rows in prices.items() for k, o, x in rows], "code string, trade_date date, open double, close double")
    told = spark.createDataFrame([("g", "a", day(2), 90.0, 8.0, 13.0, 3), ("g", "b", day(2), 80.0, 10.0, 99.0, 2), ("idle", "a", day(8), 90.0, 8.0, 13.0, 3), ("poor", "a", day(2), 90.0, 8.0, 13.0, 3)], "grid string, code string, trade_date date, score double, stop double, target double, hold int")
    paths = e.trade_paths(told.drop("hold"), bars, 3).join(told.select("grid", "code", "trade_date", "hold"), ["grid", "code", "trade_date"]).withColumn("path", F.slice("path", 1, F.col("hold") + 1))
    log = e.trade_log(paths.where("grid <> 'poor'"), cash=10_000.0, slots=2)
    got = {r["code"]: r for r in log.collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["fill_day"], a["out_day"], a["shares"], a["reason"], a["holding_bars"], a["exit_price"]) == (day(3), day(4), 400, "target", 1, 14.0)
    assert (b["fill_day"], b["out_day"], b["shares"], b["reason"], b["holding_bars"], b["exit_price"]) == (day(3), day(8), 200, "expiry", 2, 21.0)
    cash = 10_000 - 400 * 10.01 * 1.0003 - 200 * 20.02 * 1.0003
    back = 400 * 14 * 0.999 * (1 - 0.0013)
    want = {day(3): cash + 400 * 11 + 200 * 21, day(4): cash + back + 200 * 21, day(5): cash + back + 200 * 22, day(8): cash + back + 200 * 21 * 0.999 * (1 - 0.0013)}
    curve = {r["trade_date"]: r["equity"] for r in e.equity_curve(log, bars, 10_000.0).collect()}
    assert set(curve) == set(want) and all(curve[k] == pytest.approx(v) for k, v in want.items())
    stats = e.trade_stats(log).first()
    assert (stats["trades"], stats["win_rate"], stats["n_target"], stats["n_expiry"], stats["n_stop"]) == (2, 1.0, 1, 1, 0) and stats["profit_factor"] is None
    assert [tuple(r) for r in e.backtest(paths.where("grid = 'poor'"), cash=100.0).select("grid", "trades", "final_equity").collect()] == [("poor", 0, 100.0)]


def test_curves_end_where_the_ledger_does(spark, crowded):
    log = e.trade_log(evaluation.signals(spark, crowded))
    bars = evaluation.a.bars(spark, crowded).select("code", "trade_date", "close")
    last = {r["grid"]: r["x"] for r in e.equity_curve(log, bars).groupBy("grid").agg(F.max_by(F.struct("equity", "market_value"), "trade_date").alias("x")).collect()}
    totals = {r["grid"]: r["final_equity"] for r in e.backtest(evaluation.signals(spark, crowded)).collect()}
    assert last and all(x["market_value"] == pytest.approx(0, abs=0.01) and totals[g] == pytest.approx(x["equity"], abs=0.01) for g, x in last.items())


def test_the_usual_grid(spark, crowded):
    got = {r["grid"]: (r["trades"], r["wins"], r["final_equity"]) for r in registry.queries()["backtest_sweep_usual"](spark, crowded).collect()}
    want = brute(crowded, (70, 80, 90))
    assert set(got) == set(want) == {f"temp{t}_rps{s}_hold{h}" for t, s, h in evaluation.USUAL_GRID}
    assert all(got[g][:2] == w[:2] and got[g][2] == pytest.approx(w[2], abs=0.02) for g, w in want.items())


def test_a_run_extended_by_days_is_the_full_run(spark, crowded, tmp_path):
    """Three runs over a store, each on a few more days than the one before, give at every day what one run over that day's data gives; stored days aren't walked again."""
    told = evaluation.signals(spark, crowded, [(30, 80, 10), (40, 80, 20)]).cache()
    plain = lambda df: sorted(map(tuple, df.select("grid", "code", "signal_day", "fill_day", "out_day", "shares", F.round("paid", 4), F.round("received", 4), "reason").where("code IS NOT NULL").collect()), key=str)
    path, segments = f"file://{tmp_path}/s", []
    for k in (50, 51, 55, 90):
        day = F.lit(dt.date(2000, 1, 1) + dt.timedelta(days=k))
        known = told.where(F.col("trade_date") <= day).withColumn("path", F.filter("path", lambda x: x["trade_date"] <= day))  # noqa: B023
        got, want = plain(e.resumed(spark, path, known)), plain(e.trade_log(known))
        assert want and got == want, k
        segments.append(e.VersionedTable(spark, path, ("grid", "code", "signal_day"), "segment").manifest(e.VersionedTable(spark, path, (), "segment").version())["parts"])
    assert [len(s) for s in segments] == [1, 2, 3, 4] and all(set(a.items()) <= set(b.items()) for a, b in zip(segments, segments[1:], strict=False))


def test_planned_shares_go_as_far_as_the_cash(spark):
    day = lambda k: dt.date(2024, 1, k)
    path = [(day(3), 10.0, 10.0), (day(4), 10.0, 10.0)]
    rows = [("g", c, day(2), score, 1.0, 99.0, 1, shares, path) for c, score, shares in (("a", 9.0, 300.0), ("b", 8.0, 5000.0), ("c", 7.0, 100.0), ("d", 6.0, None))]
    told = spark.createDataFrame(rows, "grid string, code string, trade_date date, score double, stop double, target double, hold int, shares double, path array<struct<trade_date date, open double, close double>>")
    got = {r["code"]: r["shares"] for r in e.trade_log(told, cash=10_000.0, slots=5).collect()}
    assert got == {"a": 300, "b": 600}  # 10,000 less 300 at 10.01 and its fee leaves 600; then nothing is left for a lot
    assert e.settled_before(told) is None and e.settled_before(told.withColumn("hold", F.lit(3))) == day(2)


def test_plans_are_walked_as_a_plain_ledger_walks_them(spark):
    """Candidates and plans are those of the rules; each day's are taken in the scan's order, at their planned size as far as the cash goes."""
    sf_dir = "/root/testdata/sf0.01"
    told = sorted(evaluation.planned(spark, sf_dir).collect(), key=lambda r: (r["trade_date"], -r["score"], r["code"]))
    assert told and any(r["shares"] > 0 for r in told) and all(r["stop"] < r["target"] for r in told)
    bars: dict = {}
    for r in evaluation.a.bars(spark, sf_dir).select("code", "trade_date", "open", "close").orderBy("code", "trade_date").collect():
        bars.setdefault(r["code"], []).append(tuple(r)[1:])
    at = {(c, b[0]): k for c, path in bars.items() for k, b in enumerate(path)}
    got = {r["grid"]: (r["trades"], r["wins"], r["final_equity"]) for r in registry.queries()["backtest_plans"](spark, sf_dir).collect()}
    assert got
    for grid, found in got.items():
        temp, hold = int(grid.split("_")[0][4:]), int(grid.split("hold")[1])
        money, held, trades, wins = 1e6, [], 0, 0
        for r in told:
            path = bars[r["code"]][at[r["code"], r["trade_date"]] + 1 :][: hold + 1]
            if (50.0 if r["temperature"] is None else r["temperature"]) < temp or len(path) < 2:
                continue
            money += sum(x for d, x in held if d <= r["trade_date"])
            held = [(d, x) for d, x in held if d > r["trade_date"]]
            price = path[0][1] * 1.001
            shares = min(int(r["shares"]), int(money / (price * 1.0003) // 100 * 100))
            if len(held) >= 10 or shares <= 0:
                continue
            hit = lambda x: x <= r["stop"] or x >= r["target"]  # noqa: B023, E731
            for k, (day, o, c) in enumerate(path[1:], start=2):
                out = o if hit(o) or k == len(path) else c if hit(c) else None
                if out is not None:
                    break
            money -= shares * price * 1.0003
            held.append((day, shares * out * 0.999 * (1 - 0.0013)))
            trades, wins = trades + 1, wins + (out > price)
        assert found[:2] == (trades, wins) and found[2] == pytest.approx(money + sum(x for _, x in held), abs=0.02), grid
