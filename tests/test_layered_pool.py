"""The layered pool against a plain version that walks the gates, row by row."""

import random

import pytest

from barlattice.operators import rules

NUMBERS = "temperature rps pct_change turnover_rate volume_ratio_prev news_score close entry stop target1 risk_reward debate_confidence".split()
WORDS = "market_data structured_data board entry_style debate_verdict".split()
FLAGS = "board_top board_hot news_hot news_risk planned debate_by_rules".split()
COUNTS = "n_hints n_news".split()
GOOD = {"temperature": 72.5, "market_data": "ok", "structured_data": "ok", "board": "AI", "board_top": True, "board_hot": True, "rps": 92.0, "pct_change": 6.5, "turnover_rate": 8.5, "volume_ratio_prev": 1.8, "n_hints": 1, "news_score": 72.0, "news_hot": True, "n_news": 1, "news_risk": False,
        "close": 12.85, "entry": 12.5, "entry_style": "ma_pullback", "stop": 11.8, "target1": 14.2, "risk_reward": 2.1, "planned": True, "debate_verdict": "recommend", "debate_confidence": 85.0, "debate_by_rules": False}


def walk(x):
    against, gate, part = [], {}, {}

    def say(name, score, state, reason=None):
        part[name], gate[name] = score, state
        if reason:
            against.append(reason)

    n = lambda k, d=0.0: d if x[k] is None else x[k]
    t = n("temperature", 50.0)
    if t < 40:
        say("market", 20.0, "fail", "market_too_cold")
    else:
        score = min(100.0, max(40.0, t)) - 8 * (x["market_data"] == "degraded") - 6 * (x["structured_data"] == "degraded")
        say("market", score, "pass" if score >= 50 else "weak")
    if (x["board"] or "") in rules.NO_BOARDS:
        say("board", 35.0, "missing", "board_mapping_missing")
    elif x["board"].startswith("行业:"):
        say("board", 45.0, "weak_mapping", "board_mapping_weak")
    else:
        score = min(100.0, 55.0 + 30 * bool(x["board_top"]) + 15 * bool(x["board_hot"]))
        say("board", score, "pass" if score >= 70 else "weak")
    pct, turn, vol = n("pct_change"), n("turnover_rate"), n("volume_ratio_prev")
    score = 32 * (n("rps") >= 70) + (20 if 0 <= pct <= 9.2 else 8 if -2 <= pct < 0 else 0) + (20 if 3 <= turn <= 18 else 12 if turn == 0 and vol >= 1.5 else 0) + 14 * (vol >= 1.5) + 14 * (n("n_hints") > 0)
    say("price_volume", min(100.0, score), *(("fail", "price_volume_fail") if score < 55 else ("pass",)))
    if x["news_risk"]:
        say("news", 15.0, "fail", "negative_news_risk")
    else:
        score = n("news_score", 50.0) + 18 * bool(x["news_hot"]) + 8 * (n("n_news") > 0)
        say("news", min(100.0, max(35.0, score)), "pass" if score >= 55 else "neutral")
    buy, close = n("entry"), n("close")
    if buy and close and buy > close * 1.01:
        say("trade_plan", 20.0, "fail", "chasing_buy_point")
    elif x["entry_style"] == "breakout_confirm":
        say("trade_plan", 25.0, "fail", "chasing_buy_point")
    else:
        score = 35 * (n("risk_reward") >= 1.8) + 25 * (buy > 0 and 0 < n("stop") < buy) + 20 * (n("target1") > buy) + 10 * bool(close and buy and buy <= close * 1.005) + 10 * (x["entry_style"] in ("ma_pullback", "support_dip")) + 10 * bool(x["planned"])
        say("trade_plan", min(100.0, score), *(("fail", "trade_plan_fail") if score < 60 else ("pass",)))
    verdict, sure = x["debate_verdict"] or "", n("debate_confidence")
    if not verdict:
        say("debate", 0.0, "missing", "multi_agent_missing")
    elif verdict == "avoid":
        say("debate", *((min(35.0, max(20.0, sure)), "rule_warn") if x["debate_by_rules"] else (10.0, "fail", "multi_agent_rejected")))
    elif verdict != "recommend":
        say("debate", min(60.0, sure), "weak")
    elif sure < 70:
        say("debate", sure, "weak", "multi_agent_low_confidence")
    else:
        say("debate", min(100.0, 70.0 + (sure - 70) * 0.75), "pass")
    total = min(100.0, max(0.0, sum(part[k] * w for k, w in rules.POOL_PARTS.items())))
    waits = "multi_agent_missing" in against and set(against) == {"multi_agent_missing"} and total >= 60
    if "multi_agent_missing" in against and not waits:
        against.remove("multi_agent_missing")
        gate["debate"] = "not_scoped"
    trial = gate["debate"] == "rule_warn" and total >= 62 and all(gate[k] == "pass" for k in ("board", "price_volume", "trade_plan")) and not set(against) - {"price_volume_fail"}
    out = set(against) & {"negative_news_risk", "trade_plan_fail", "chasing_buy_point", "multi_agent_rejected"}
    status = "core" if trial or total >= 75 and not against else "pending" if waits else "rejected" if out else "watch"
    return {"pool_score": total, "gates": ",".join(gate[k] for k in rules.POOL_PARTS), "blockers": ",".join(against), "pool_status": status}


def derived(spark, rows):
    schema = ", ".join(["id long", *(f"{c} double" for c in NUMBERS), *(f"{c} string" for c in WORDS), *(f"{c} boolean" for c in FLAGS), *(f"{c} int" for c in COUNTS)])
    df = spark.createDataFrame([(k, *(x[c] for c in NUMBERS + WORDS + FLAGS + COUNTS)) for k, x in enumerate(rows)], schema)
    return [r for r in sorted(rules.derive(df, rules.layered_pool()).collect(), key=lambda r: r["id"])]


def test_rows_are_those_of_the_walk(spark):
    rnd, rows = random.Random(3), []
    for k in range(1500):
        x = dict(GOOD)
        for c in rnd.sample(list(GOOD), rnd.randint(0, 5)):
            x[c] = {"temperature": rnd.uniform(20, 110), "market_data": "degraded", "structured_data": "degraded", "board": rnd.choice(["", "行业:化工", "其他", None, "X"]), "rps": rnd.uniform(50, 90), "pct_change": rnd.uniform(-5, 12), "turnover_rate": rnd.choice([0.0, 2.0, 18.0, 30.0]),
                    "volume_ratio_prev": rnd.uniform(0, 3), "n_hints": 0, "news_score": rnd.uniform(0, 100), "n_news": 0, "close": rnd.uniform(10, 14), "entry": rnd.uniform(10, 14), "entry_style": rnd.choice(["breakout_confirm", "support_dip", "other"]), "stop": rnd.uniform(10, 14), "target1": rnd.uniform(10, 14),
                    "risk_reward": rnd.uniform(0, 3), "debate_verdict": rnd.choice(["avoid", "watch", "", None]), "debate_confidence": rnd.uniform(0, 100)}.get(c, rnd.choice([True, False, None]) if c in FLAGS else None)
            if rnd.random() < 0.1:
                x[c] = None
        rows.append(x)
    statuses = set()
    for x, got in zip(rows, derived(spark, rows), strict=True):
        want = walk(x)
        assert got["pool_score"] == pytest.approx(want.pop("pool_score"), abs=1e-9), x
        assert {k: got[k] for k in want} == want, x
        statuses.add(want["pool_status"])
    assert statuses == {"core", "pending", "watch", "rejected"}


@pytest.mark.parametrize(("change", "status", "blocker"), [
    ({}, "core", ""), ({"board": "全市场强势", "debate_verdict": None}, "watch", "board_mapping_missing"), ({"debate_verdict": None}, "pending", "multi_agent_missing"), ({"news_risk": True}, "rejected", "negative_news_risk"),
    ({"board": "行业:化工"}, "watch", "board_mapping_weak"), ({"entry": 13.2, "entry_style": "breakout_confirm"}, "rejected", "chasing_buy_point"), ({"debate_verdict": "avoid", "debate_by_rules": True, "debate_confidence": 30.0}, "core", ""), ({"debate_confidence": 60.0}, "watch", "multi_agent_low_confidence"),
])
def test_known_cases(spark, change, status, blocker):
    got = derived(spark, [GOOD | change])[0]
    assert (got["pool_status"], got["blockers"]) == (status, blocker)
