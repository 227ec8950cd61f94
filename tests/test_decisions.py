"""Rules of the decision layer against plain Python, row by row, and small tables with known results."""

import random

import pytest
from pyspark.sql import functions as F

from barlattice.functions import scalars as s
from barlattice.operators import decisions as d
from barlattice.operators import rules

NUMBERS = "close ma5 ma10 ma20 ma30 ma60 rps pct_change volume_ratio_prev inflow_days turnover_rate entry stop risk_reward atr14 lhb_net_wan hot_rank flow20 north5 margin5 unlock_ratio holder_qoq news_score cal_prob cal_ret pe prior_high20".split()


def made_rows(n=400):
    rnd, rows = random.Random(11), []
    for k in range(n):
        close = rnd.uniform(5, 50)
        near = lambda w: close * rnd.uniform(1 - w, 1 + w)  # noqa: B023, E731
        big = lambda x: rnd.choice([None, 0.0, rnd.uniform(-x, x)])
        x = {"close": close, "ma5": near(0.1), "ma10": near(0.1), "ma20": near(0.1), "ma30": near(0.1), "ma60": near(0.1), "rps": rnd.choice([None, rnd.uniform(0, 100)]), "pct_change": rnd.uniform(-11, 11), "volume_ratio_prev": rnd.uniform(0.3, 4), "inflow_days": float(rnd.choice([0, 0, 1, 3, 9])),
             "turnover_rate": rnd.choice([None, rnd.uniform(0, 40)]), "entry": near(0.05), "stop": close * rnd.uniform(0.7, 1.02), "risk_reward": rnd.choice([None, rnd.uniform(0, 4)]), "atr14": rnd.choice([None, close * rnd.uniform(0.01, 0.1)]), "lhb_net_wan": big(20_000), "hot_rank": rnd.choice([None, 0.0, float(rnd.randint(1, 200))]),
             "flow20": big(9e8), "north5": big(5e8), "margin5": big(3e8), "unlock_ratio": rnd.choice([None, rnd.uniform(0, 10)]), "holder_qoq": big(10), "news_score": rnd.choice([None, rnd.uniform(30, 100)]), "cal_prob": rnd.choice([None, 0.6]), "cal_ret": rnd.choice([None, rnd.uniform(-0.02, 0.05)]), "pe": rnd.choice([None, -3.0, 20.0, 70.0, 130.0]), "prior_high20": near(0.1)}
        rows.append(x | {"id": k, "golden_cross": rnd.choice([None, True, False]), "n_flags": rnd.choice([0, 1, 3]), "n_research": rnd.choice([None, 0, 2]), "n_ann_risks": rnd.choice([0, 1, 5]), "n_block_trades": rnd.choice([None, 0, 1]), "news_theme": rnd.choice([None, "", "hot > ", "hot > Robots", "Chips", "a > very long theme name"]), "cal_flag": rnd.choice(["", "fallback_baseline", "low"]),
                         "t_break": rnd.choice([0.0, 25.0]), "t_volume": rnd.choice([0.0, 20.0]), "t_bull": rnd.choice([0.0, 25.0])})
    return rows


def clip(x, low=0.0, high=100.0):
    return max(low, min(high, x))


def factors(x):
    v = {k: x[k] or 0.0 for k in ("lhb_net_wan", "hot_rank", "flow20", "margin5", "n_research", "unlock_ratio", "n_ann_risks", "north5", "n_block_trades", "holder_qoq")}
    up = down = 0.0
    for name, (by, most, by_down, most_down) in {"lhb_net_wan": (3e3, 4, 4e3, 3), "flow20": (8e7, 4, 1.2e8, 3), "north5": (1e8, 2, 1.5e8, 2)}.items():
        up += min(most, v[name] / by) if v[name] > 0 else 0
        down += min(most_down, -v[name] / by_down) if v[name] < 0 else 0
    up += min(3.0, max(0.5, (101 - v["hot_rank"]) / 30)) if 0 < v["hot_rank"] <= 100 else 0
    up += min(1.5, v["margin5"] / 1e8) if v["margin5"] > 0 else 0
    up += (v["n_research"] > 0) + (v["holder_qoq"] < -3)
    down += min(5.0, v["unlock_ratio"] * 0.8) + min(5.0, v["n_ann_risks"] * 1.5) + (v["n_block_trades"] > 0) + (v["holder_qoq"] > 5)
    return (clip(up * 12 - down * 8 + 50) if up or down else 0.0), min(10.0, up), min(10.0, down)


def expected(x):
    rps, pct, turn, rr = 50.0 if x["rps"] is None else x["rps"], x["pct_change"], x["turnover_rate"] or 0.0, x["risk_reward"] or 0.0
    bull, gold = x["ma5"] > x["ma10"] > x["ma30"], bool(x["golden_cross"])
    trend = clip(clip((rps - 50) * 2.5) + 10 * bull + 10 * (x["close"] > x["ma60"]) + 10 * gold)
    fund = min(100.0, x["inflow_days"] * 12.5)
    pattern = clip(25 * bull + 15 * (x["close"] > x["ma60"]) + 20 * (x["volume_ratio_prev"] >= 1.5) + 15 * gold + clip(pct * 3, 0, 25))
    width = (x["entry"] - x["stop"]) / x["entry"] if x["entry"] > x["stop"] else 0.0
    quality = 100 if 0.03 <= width <= 0.08 else 40 if width < 0.015 else 70 if width <= 0.15 else 40
    reward = clip(clip((rr - 0.5) * 40) * 0.6 + quality * 0.4)
    control = clip(100 - abs(turn - 8) * 4 if 3 <= turn <= 15 else 40 if turn < 3 else max(0.0, 100 - (turn - 15) * 5))
    score, bonus, penalty = factors(x)
    bonus, penalty = round(bonus, 2), round(penalty, 2)
    control = max(0.0, max(0.0, control - min(40.0, 20.0 * x["n_flags"])) - penalty)
    word = (x["news_theme"] or "").split(">")[-1].strip()
    news = min(8.0, x["news_score"] / 100 * 8) if (x["news_score"] or 0) >= 60 and word else 0.0
    total = clip(min(100.0, trend * 0.36 + fund * 0.26 + pattern * 0.18 + reward * 0.1 + control * 0.1 + min(5.0, news)) + bonus - penalty * 0.5)
    momentum = clip(rps * 0.5 + pct * 3 + x["volume_ratio_prev"] * 5)
    ret = x["close"] / x["ma20"] - 1
    atr = 1.5 if x["atr14"] is None else round(x["atr14"] / x["close"] * 100, 2)
    base = (ret + rps / 100 * 0.08 + 0.02 * bull + 0.015 * gold) * clip(max(1.0, (5.0 if x["turnover_rate"] is None else turn) / 5) / 2, 1.0, 2.5)
    calibrated = (x["cal_ret"] or 0) > 0 and bool(x["cal_prob"]) and x["cal_flag"] not in ("", "fallback_baseline")
    high = max(5.0, x["cal_ret"] * 300) if calibrated else max(5.0, base * 100 + atr * 1.2)
    low = max(2.0, x["cal_ret"] * 150) if calibrated else min(max(2.0, base * 100 - atr * 0.6), high * 0.85)
    sure = x["cal_prob"] * 100 if calibrated else clip(35 + total * 0.35, 30, 72)
    parts = [w for w, t in zip(("趋势强", "资金流入", "动量强", "突破", "放量", "多头排列"), (trend >= 70, fund >= 60, momentum >= 65, x["t_break"] > 0, x["t_volume"] > 0, x["t_bull"] > 0), strict=True) if t] + ([f"{word}催化"] if 2 <= len(word) <= 8 else [])
    debate = 50 + (10 if x["ma5"] > x["ma10"] > x["ma20"] else -8) + (10 if x["close"] > x["prior_high20"] else -5) + (6 if x["volume_ratio_prev"] >= 1.5 else -3) + (8 if x["inflow_days"] >= 2 else -4)
    debate += (-6 if x["pe"] > 100 else 3 if x["pe"] < 50 else 0) if (x["pe"] or 0) > 0 else 0
    debate += -8 if pct > 7 else 3 if pct > 0 else 0
    return {"structured_score": score, "recommend_score": total, "news_bonus": news, "confidence": sure, "target_low": low, "target_high": high, "s_momentum": momentum, "tag": ("+".join(parts[:3]) or "形态企稳")[:16], "grade": "S" if total >= 85 else "A" if total >= 70 else "B" if total >= 55 else "C", "debate_score": clip(debate)}


def test_scores_bands_tags_and_debate_are_the_plain_ones(spark):
    rows = made_rows()
    schema = ", ".join([f"{c} double" for c in NUMBERS] + ["id long", "golden_cross boolean", "n_flags int", "n_research int", "n_ann_risks int", "n_block_trades int", "news_theme string", "cal_flag string", "t_break double", "t_volume double", "t_bull double"])
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(x[c] for c in names) for x in rows], schema)
    layers = [*rules.structured(), *rules.news_bonus(), *rules.recommendation(), *rules.outlook(), *rules.tags(), *rules.debate()]
    got = {r["id"]: r for r in rules.derive(df, layers).collect()}
    for x in rows:
        for k, v in expected(x).items():
            assert got[x["id"]][k] == (pytest.approx(v, abs=0.02) if isinstance(v, float) else v), (k, x)


def test_limit_up_pool_terms(spark):
    test, score = rules.POOLS["limit_up"]
    rows = [(True, 1, 10.0, 925, 0, 0.2, 5.0), (True, 3, 20.0, 938, 2, None, 2.0), (True, 1, 10.0, None, 9, 0.0, 35.0), (True, 9, 20.0, 930, 0, 0.5, 10.0), (False, 1, 10.0, 925, 0, 0.2, 5.0)]
    df = spark.createDataFrame(rows, "is_up boolean, streak int, pct_change double, first_seal int, n_broken int, seal_ratio double, turnover_rate double")
    assert [r[0] for r in df.where(test).select(F.expr(score).cast("double")).collect()] == [83.0, 77.0, 20.0, 95.0]


def test_columns_limits_and_intervals(spark):
    names = ["涨跌幅.1", "涨跌幅(%)", "换手率", "主力净流入-净额"]
    assert [s.resolve(names, x) for x in (["换手率"], ["涨跌幅"], ["净流入"], ["x", "净额"], ["none"])] == ["换手率", "涨跌幅.1", "主力净流入-净额", "主力净流入-净额", None]
    df = spark.createDataFrame([("600001",), ("300001",), ("688001",), ("430001",), ("60001",), (None,)], "c string")
    assert [tuple(r) for r in df.select(s.is_a_share(F.col("c")), s.up_limit(F.col("c"))).collect()] == [(True, 9.5), (True, 19.5), (True, 19.5), (False, 9.5), (False, 9.5), (False, 9.5)]
    one = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double").groupBy("k").agg(*[v.alias(k) for k, v in s.mean_interval("x").items()]).orderBy("k").collect()
    assert tuple(one[0])[1:] == (1.0, 1.0) and one[1]["mean_low"] == pytest.approx(2 - 1.96) and one[1]["mean_high"] == pytest.approx(2 + 1.96)


def test_evidence_takes_the_first_bucket_and_the_best_signal(spark):
    schema = "code string, name string, close double, pct_change double, rps double, turnover_rate double, circ_mv_yi double"
    final = spark.createDataFrame([("1", "a", 1.0, 2.0, 90.0, None, 5.0)], schema)
    watch = spark.createDataFrame([("1", "b", 9.0, 9.0, 9.0, 9.0, 9.0), ("2", "c", 1.0, 2.0, 80.0, 3.0, 5.0)], schema)
    signals = spark.createDataFrame([("1", "leader", 60.0, "x"), ("1", "trend", 70.0, "y"), ("3", "trend", 1.0, "z")], "code string, strategy string, score double, trigger string")
    guards = spark.createDataFrame([("1", "kept")], "code string, guard_status string")
    got = {r["code"]: r for r in d.evidence({"final": final, "watch": watch}, signals, guards, "rising", "ok").collect()}
    assert set(got) == {"1", "2"} and got["1"]["status"] == "final" and got["1"]["name"] == "a" and got["1"]["strategy_evidence"]["strategy"] == "trend"
    assert got["1"]["liquidity"]["turnover_missing"] and got["1"]["guarded_state"] == "kept" and got["2"]["guarded_state"] == "unknown" and got["2"]["strategy_evidence"]["is_trend_only"]


def test_quality_verdict(spark):
    ok = [(s, "ok") for s in ("all_spot", "daily_kline", "entry_exit", "rps", "fund_flow", "quant_guard", "volume_audit")]
    states = [("good", *x) for x in ok] + [("core", *x) for x in [*ok[1:], ("all_spot", "failed")]] + [("rps", *x) for x in ok if x[0] != "rps"] + [("gap", *x) for x in ok]
    fields = [(r, None if r == "gap" and k < 4 else 1.0, 1.0, 1.0, k == 0) for r in ("good", "core", "rps", "gap") for k in range(10)]
    got = {r["run"]: (r["verdict"], r["tradable"]) for r in d.quality_verdict(spark.createDataFrame(states, "run string, source string, status string"), spark.createDataFrame(fields, "run string, close double, pct_change double, turnover_rate double, is_final boolean")).collect()}
    assert got == {"good": ("ok", True), "core": ("failed", False), "rps": ("degraded", False), "gap": ("failed", False)}


def test_lookups_and_empty_tables(spark):
    rps = spark.createDataFrame([("1", 90.0)], "code string, rps double")
    codes = spark.createDataFrame([("1",), ("2",), ("1",)], "code string")
    assert {tuple(r) for r in d.rps_for_codes(codes, rps).collect()} == {("1", 90.0, "real"), ("2", None, "missing")}
    closes, changes = spark.createDataFrame([("1", 0.1), ("2", None)], "code string, ret20 double"), spark.createDataFrame([(-1.0,), (0.1,), (5.0,), (None,)], "pct_change double")
    assert {tuple(r) for r in d.approximate_rps(closes, changes).select("code", F.round("rps", 3)).collect()} == {("1", 33.333), ("2", 50.0)}
    assert {tuple(r) for r in d.approximate_rps(closes, changes.limit(0)).collect()} == {("1", 50.0), ("2", 50.0)}
    assert d.latest(spark.createDataFrame([], "day string, path string"), ["day"]).count() == 0
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "kind string, at int, path string")
    assert {tuple(r) for r in d.latest(runs, ["at"], ["kind"]).select("kind", "path").collect()} == {("a", "y"), ("b", "z")}
