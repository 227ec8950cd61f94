"""Stock-level rules: scores, patterns, guards, plans and gates as layers of SQL expressions over one wide row per stock.

A layer is a dict of column name to expression; a layer may use the columns of those before it. All are row-wise, so a
chain of them is a single projection in generated code. `derive` applies layers; thresholds come from the caller.
Ordered rules ("first failing gate wins") are CASE expressions in that order; a null test doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Layers = list[dict[str, str]]


def derive(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        df = df.withColumns({k: F.expr(e) for k, e in layer.items()})
    return df


def flag(test: str, points: float, otherwise: float = 0) -> str:
    return f"CASE WHEN {test} THEN {float(points)} ELSE {float(otherwise)} END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {float(low)}), {float(high)}) END"


def trend_score(hard_min: float = 80, strong: float = 90, volume: float = 1.5, days: int = 3, cap: tuple[float, float] = (30, 500)) -> Layers:
    """Moving averages in order 25, breakout 25, volume 20, strength 20 or 10, inflow 10; selected if strong enough, in the cap range and with any reason."""
    return [
        {"t_bull": flag("ma5 > ma10 AND ma10 > ma20", 25), "t_break": flag("prior_n = 20 AND close > prior_high20", 25), "t_volume": flag(f"rn >= 6 AND volume_ratio_incl >= {volume}", 20), "t_rps": f"CASE WHEN rps >= {strong} THEN 20.0 WHEN rps >= {hard_min} THEN 10.0 ELSE 0.0 END"},
        {"trend_points": "t_bull + t_break + t_volume + t_rps"},
        {"trend_points": f"trend_points + CASE WHEN inflow_days >= {days} THEN 10.0 ELSE 0.0 END", "selected": f"rn >= 22 AND rps >= {hard_min} AND trend_points > 0 AND (circ_mv_yi <= 0 OR circ_mv_yi BETWEEN {cap[0]} AND {cap[1]})"},
        {"order_key": "0.55 * rps + 6 * least(inflow_days, 5) + 0.35 * trend_points + CASE WHEN trend_points >= 30 THEN 20.0 ELSE 0.0 END"},
    ]


def volume_audit() -> Layers:
    """The first of seven price and volume patterns; fewer than ten rows: missing."""
    return [
        {"is_break": "prior_high20 > 0 AND close > prior_high20 * 1.005", "is_near": "prior_high20 > 0 AND close >= prior_high20 * 0.97", "is_rebound": "prior_low20 > 0 AND close > prev_close AND close > prior_low20 * 1.05", "r5": "coalesce(ret5, 0.0)"},
        {"volume_pattern": "CASE WHEN rn < 10 OR volume_ratio_prev IS NULL THEN 'missing' WHEN is_break AND volume_ratio_prev >= 1.35 THEN 'breakout_with_volume' WHEN is_break AND volume_ratio_prev < 1.1 THEN 'breakout_without_volume' WHEN r5 < 0 AND volume_ratio_prev <= 0.85 THEN 'pullback_shrink' "
         "WHEN is_near AND abs(close / prev_close - 1) < 0.015 AND volume_ratio_prev >= 1.8 THEN 'distribution_volume' WHEN r5 <= -0.08 AND volume_ratio_prev >= 2.0 THEN 'panic_volume' WHEN is_rebound AND volume_ratio_prev < 0.9 THEN 'weak_rebound_no_volume' ELSE 'normal' END"},
        {"volume_status": "CASE WHEN volume_pattern = 'missing' THEN 'missing' WHEN volume_pattern IN ('breakout_without_volume', 'distribution_volume', 'panic_volume', 'weak_rebound_no_volume') OR turnover_rate IS NULL THEN 'watch' ELSE 'ok' END", "volume_anomaly": "CASE WHEN volume_ratio_prev >= 3 THEN 'surge' WHEN volume_ratio_prev <= 0.4 THEN 'dry' END", "obv_label": "CASE WHEN obv5 > 0 THEN 'up' WHEN obv5 < 0 THEN 'down' WHEN obv5 = 0 THEN 'flat' ELSE 'missing' END"},
    ]


#: Limits of 3-row return, 5-row return, distance from ma5 and ma20, change of the day, by strategy; the first column is the default.
CHASE_LIMITS = {
    "default": (0.18, 0.30, 0.08, 0.20, 0.07), "leader": (0.25, 0.40, 0.10, 0.25, 0.09), "limit_up": (0.15, 0.25, 0.07, 0.18, 0.06), "trend_pullback": (0.15, 0.25, 0.07, 0.18, 0.05), "oversold_rebound": (0.12, 0.20, 0.08, 0.15, 0.05),
}


def anti_chase(strategy: str = "strategy") -> Layers:
    """Watch when a limit is passed, blocked on a hot 5-row return of a stock that leads nothing, or on a rise with shrinking volume. A leader's limits come before its strategy's."""
    pick = lambda k: "CASE " + " ".join(f"WHEN {strategy} = '{s}' THEN {v[k]}" for s, v in CHASE_LIMITS.items() if s != "default") + f" ELSE {CHASE_LIMITS['default'][k]} END"
    return [
        {"l_ret3": pick(0), "l_ret5": pick(1), "l_ma5": pick(2), "l_ma20": pick(3), "l_day": pick(4), "dist5": "(close - ma5) / nullif(ma5, 0)", "dist20": "(close - ma20) / nullif(ma20, 0)"},
        {"chase_watch": "coalesce(ret3 > l_ret3, false) OR coalesce(dist5 > l_ma5, false) OR coalesce(dist20 > l_ma20, false) OR coalesce(pct_change / 100 > l_day, false) OR coalesce(ret5 > l_ret5, false)", "chase_blocked": f"coalesce(ret5 > l_ret5, false) AND {strategy} <> 'leader' OR coalesce(shrinking, false)"},
        {"chase_status": "CASE WHEN chase_blocked THEN 'blocked' WHEN chase_watch THEN 'watch' ELSE 'ok' END"},
    ]


def quant_guard(min_price: float = 2.0, min_rows: int = 60, max_debt: float = 80.0) -> Layers:
    """First hit wins: special treatment, one-price limit, valuation, short history, debt, loss. Missing valuation alone: watch."""
    return [
        {"guard_reason": f"CASE WHEN upper(name) LIKE '%ST%' OR name LIKE '%退%' THEN 'special_treatment' WHEN close < {min_price} THEN 'price' WHEN abs(open / close - 1) <= 0.001 AND abs(low / close - 1) <= 0.001 AND is_up THEN 'one_price_limit' WHEN pe > 150 OR pb > 20 THEN 'valuation' WHEN rn < {min_rows} THEN 'short_history' WHEN debt_ratio > {max_debt} THEN 'debt' WHEN profit < 0 THEN 'loss' END"},
        {"guard_status": "CASE WHEN guard_reason IS NOT NULL THEN 'rejected' WHEN pe IS NULL OR pb IS NULL THEN 'watch' ELSE 'kept' END"},
    ]


def entry_exit(atr_multiplier: float = 2.0, min_stop: float = 0.015, ma20_buffer: float = 0.03, min_risk: float = 0.01) -> Layers:
    """Buy points (breakout, pullbacks to averages, support, box middle, reclaim), the primary one, the widest stop that is wide enough, targets at 2 and 3 times the risk."""
    pulls = {n: f"CASE WHEN ma{n} > 0 AND ma{n} < close * 1.005 THEN ma{n} END" for n in (5, 10, 20)}
    return [
        {**{f"pull{n}": e for n, e in pulls.items()}, "box_mid": "CASE WHEN (recent_high20 - recent_low20) / greatest(recent_low20, 0.000000001) > 0.03 AND close BETWEEN recent_low20 AND recent_high20 AND close <= (recent_high20 + recent_low20) / 2 * 1.005 AND (recent_high20 + recent_low20) / 2 < close * 1.02 THEN (recent_high20 + recent_low20) / 2 END", "reclaim": "CASE WHEN ma5 > ma20 AND ma10 > ma20 AND ma10 < close * 1.005 THEN ma10 END"},
        {**{f"act{n}": f"CASE WHEN pull{n} >= close * 0.92 THEN pull{n} END" for n in (5, 10, 20)}, "support_ok": "recent_low20 BETWEEN close * 0.88 AND close * 1.002"},
        {"best_act": "greatest(act5, act10, act20)", "best_pull": "greatest(pull5, pull10, pull20)"},
        {"entry": "CASE WHEN best_act IS NOT NULL THEN best_act WHEN support_ok THEN recent_low20 WHEN best_pull IS NOT NULL THEN best_pull WHEN recent_low20 > 0 THEN recent_low20 ELSE recent_high20 END", "entry_style": "CASE WHEN best_act IS NOT NULL THEN 'ma_pullback' WHEN support_ok THEN 'support_dip' WHEN best_pull IS NOT NULL THEN 'ma_pullback' WHEN recent_low20 > 0 THEN 'support_dip' ELSE 'breakout_confirm' END",
         "n_points": "2 + CASE WHEN pull5 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN pull10 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN pull20 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN box_mid IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN reclaim IS NOT NULL THEN 1 ELSE 0 END"},
        {"stop_floor": f"entry * (1 - {min_stop})", "stop_atr": f"entry - {atr_multiplier} * atr14", "stop_low": "recent_low20", "stop_ma": f"ma20 * (1 - {ma20_buffer})"},
        {f"w_{k}": f"CASE WHEN stop_{k} > 0 AND stop_{k} < entry AND stop_{k} <= stop_floor THEN stop_{k} END" for k in ("atr", "low", "ma")},
        {"stop": "coalesce(least(w_atr, w_low, w_ma), stop_floor)"},
        {"stop_method": "CASE WHEN w_atr = stop THEN 'atr' WHEN w_low = stop THEN 'structure' WHEN w_ma = stop THEN 'ma20' ELSE 'fixed' END", "risk": f"CASE WHEN entry - stop <= 0 THEN entry * {min_risk} ELSE entry - stop END"},
        {"target1": "entry + 2 * risk", "target2": "entry + 3 * risk", "trailing": "ma10", "risk_reward": "(recent_high20 - entry) / risk"},
    ]


def position(account: float = 100_000.0, risk_share: float = 0.01, min_amount: float = 5_000.0) -> Layers:
    """Shares by the risk of one trade times the emotion factor, in lots of 100, at least one lot and the smallest amount."""
    return [
        {"raw_shares": f"floor({account} * {risk_share} * emotion / risk / 100) * 100"},
        {"shares": f"CASE WHEN emotion <= 0 THEN 0.0 WHEN entry * greatest(raw_shares, 100.0) < {min_amount} THEN floor(({min_amount} / entry + 99) / 100) * 100 ELSE greatest(raw_shares, 100.0) END"},
        {"risk_pct": f"shares * risk / {account} * 100"},
    ]


#: What a structured factor adds or takes: column, divisor, most; for sums that speak by their sign, in both directions.
SIGNED_FACTORS = {"lhb_net_wan": (3_000.0, 4.0, 4_000.0, 3.0), "flow20": (80_000_000.0, 4.0, 120_000_000.0, 3.0), "north5": (100_000_000.0, 2.0, 150_000_000.0, 2.0)}


def structured() -> Layers:
    """Ten structured factors, each graded by its size: bonus and penalty, ten at most each. A null factor says nothing.

    Columns: lhb_net_wan (net buying on the dragon-tiger list, 10,000 yuan), hot_rank, flow20 and north5 (net yuan), margin5 (change, yuan),
    n_research, unlock_ratio (per cent), n_ann_risks, n_block_trades, holder_qoq (per cent)."""
    up = {f"b_{c}": f"CASE WHEN {c} > 0 THEN least({most}, {c} / {by}) ELSE 0.0 END" for c, (by, most, _, _) in SIGNED_FACTORS.items()}
    down = {f"p_{c}": f"CASE WHEN {c} < 0 THEN least({most}, -{c} / {by}) ELSE 0.0 END" for c, (_, _, by, most) in SIGNED_FACTORS.items()}
    up |= {"b_hot": "CASE WHEN hot_rank > 0 AND hot_rank <= 100 THEN least(3.0, greatest(0.5, (101.0 - hot_rank) / 30.0)) ELSE 0.0 END", "b_margin": "CASE WHEN margin5 > 0 THEN least(1.5, margin5 / 100000000.0) ELSE 0.0 END", "b_research": flag("n_research > 0", 1), "b_holder": flag("holder_qoq < -3", 1)}
    down |= {"p_unlock": "CASE WHEN unlock_ratio > 0 THEN least(5.0, unlock_ratio * 0.8) ELSE 0.0 END", "p_ann": "CASE WHEN n_ann_risks > 0 THEN least(5.0, n_ann_risks * 1.5) ELSE 0.0 END", "p_block": flag("n_block_trades > 0", 1), "p_holder": flag("holder_qoq > 5", 1)}
    return [
        {**up, **down},
        {"all_bonus": " + ".join(up), "all_penalty": " + ".join(down)},
        {"structured_score": f"CASE WHEN all_bonus > 0 OR all_penalty > 0 THEN {clip('all_bonus * 12.0 - all_penalty * 8.0 + 50.0', 0, 100)} ELSE 0.0 END", "structured_bonus": "round(least(10.0, all_bonus), 2)", "structured_penalty": "round(least(10.0, all_penalty), 2)"},
    ]


def news_bonus(weight: float = 0.08) -> Layers:
    """Bonus of a positive news score (60 and more) with a theme: its share of the weight, in points. A theme is the last part of a path; any that isn't empty counts. Columns: news_score, news_theme."""
    return [
        {"theme_word": "trim(regexp_replace(coalesce(news_theme, ''), '^.*>', ''))"},
        {"news_bonus": f"CASE WHEN coalesce(news_score, 0.0) >= 60 AND theme_word <> '' THEN least({weight * 100}, news_score / 100.0 * {weight * 100}) ELSE 0.0 END"},
    ]


def recommendation() -> Layers:
    """Trend .36, fund .26, pattern .18, risk-reward .10, risk control .10, then at most 5 for news and the structured bonus less half the penalty; grades S, A, B, C.

    Needs golden_cross, n_flags (risk flags of guards), and the columns of `structured` and `news_bonus`; null ones say nothing."""
    bull = "ma5 > ma10 AND ma10 > ma30"
    return [
        {"s_trend": clip(f"{clip('(coalesce(rps, 50.0) - 50.0) * 2.5', 0, 100)} + {flag(bull, 10)} + {flag('close > ma60', 10)} + {flag('golden_cross', 10)}", 0, 100), "s_fund": "CASE WHEN inflow_days > 0 THEN least(100.0, inflow_days * 12.5) ELSE 0.0 END",
         "s_pattern": clip(f"{flag(bull, 25)} + {flag('close > ma60', 15)} + {flag('volume_ratio_prev >= 1.5', 20)} + {flag('golden_cross', 15)} + coalesce({clip('pct_change * 3.0', 0, 25)}, 0.0)", 0, 100), "risk_width": "CASE WHEN entry > stop AND stop > 0 THEN (entry - stop) / entry ELSE 0.0 END"},
        {"s_quality": "CASE WHEN risk_width BETWEEN 0.03 AND 0.08 THEN 100.0 WHEN risk_width < 0.015 THEN 40.0 WHEN risk_width < 0.03 THEN 70.0 WHEN risk_width <= 0.15 THEN 70.0 ELSE 40.0 END",
         "s_turnover": "CASE WHEN turnover_rate BETWEEN 3 AND 15 THEN 100.0 - abs(turnover_rate - 8) * 4 WHEN turnover_rate > 15 THEN greatest(0.0, 100.0 - (turnover_rate - 15) * 5) ELSE 40.0 END",
         "s_momentum": clip("coalesce(rps, 50.0) * 0.5 + coalesce(pct_change, 0.0) * 3.0 + coalesce(volume_ratio_prev, 0.0) * 5.0", 0, 100)},
        {"s_control": f"greatest(0.0, greatest(0.0, {clip('s_turnover', 0, 100)} - least(40.0, 20.0 * coalesce(n_flags, 0))) - structured_penalty)", "s_rr": clip(f"{clip('(coalesce(risk_reward, 0.0) - 0.5) * 40.0', 0, 100)} * 0.6 + s_quality * 0.4", 0, 100)},
        {"recommend_score": "least(100.0, s_trend * 0.36 + s_fund * 0.26 + s_pattern * 0.18 + s_rr * 0.10 + s_control * 0.10 + least(5.0, news_bonus))"},
        {"recommend_score": clip("recommend_score + structured_bonus - structured_penalty * 0.5", 0, 100)},
        {"grade": "CASE WHEN recommend_score >= 85 THEN 'S' WHEN recommend_score >= 70 THEN 'A' WHEN recommend_score >= 55 THEN 'B' ELSE 'C' END"},
    ]


def outlook() -> Layers:
    """Confidence and target band: the calibrated ones where there are any to trust, else from the score and the stock's own features. Columns: cal_prob, cal_ret, cal_flag (of `predict`); null without calibration."""
    trusted = "cal_ret > 0 AND cal_prob > 0 AND coalesce(cal_flag, '') NOT IN ('', 'fallback_baseline')"
    return [
        {"calibrated": f"coalesce({trusted}, false)", "f_ret": "CASE WHEN ma20 > 0 AND close > 0 THEN close / ma20 - 1 ELSE coalesce(rps, 50.0) / 100.0 * 0.2 END", "f_atr": "coalesce(round(atr14 / close * 100, 2), 1.5)", "f_volume": "greatest(1.0, coalesce(turnover_rate, 5.0) / 5.0)"},
        {"f_base": f"(f_ret + coalesce(rps, 50.0) / 100.0 * 0.08 + {flag('ma5 > ma10 AND ma10 > ma30', 0.02)} + {flag('golden_cross', 0.015)}) * greatest(1.0, least(2.5, f_volume / 2.0))"},
        {"target_high": "CASE WHEN calibrated THEN greatest(5.0, cal_ret * 300.0) ELSE greatest(5.0, f_base * 100 + f_atr * 1.2) END"},
        {"target_low": "CASE WHEN calibrated THEN greatest(2.0, cal_ret * 150.0) ELSE least(greatest(2.0, f_base * 100 - f_atr * 0.6), target_high * 0.85) END", "confidence": f"CASE WHEN calibrated THEN cal_prob * 100 ELSE {clip('35 + 0.35 * recommend_score', 30, 72)} END"},
    ]


#: The phrases of a recommendation's tag, in order, with the test for each.
TAGS = (("趋势强", "s_trend >= 70"), ("资金流入", "s_fund >= 60"), ("动量强", "s_momentum >= 65"), ("突破", "t_break > 0"), ("放量", "t_volume > 0"), ("多头排列", "t_bull > 0"))
NO_TAG, NEWS_TAG = "形态企稳", "催化"


def tags() -> Layers:
    """The first three phrases that hold, at most 16 characters; a news theme of two to eight characters comes last."""
    tests = [*((f"'{word}'", test) for word, test in TAGS), (f"concat(theme_word, '{NEWS_TAG}')", "length(theme_word) BETWEEN 2 AND 8")]
    on = {f"tag{k}": f"CASE WHEN {test} THEN 1 ELSE 0 END" for k, (_, test) in enumerate(tests)}
    before = lambda k: " + ".join(["0", *(f"tag{j}" for j in range(k))])
    parts = ", ".join(f"CASE WHEN tag{k} = 1 AND {before(k)} < 3 THEN {word} END" for k, (word, _) in enumerate(tests))
    return [on, {"tag": f"CASE WHEN {before(len(tests))} = 0 THEN '{NO_TAG}' ELSE substr(concat_ws('+', {parts}), 1, 16) END"}]


def debate() -> Layers:
    """Verdict of bull and bear points around 50, kept between 0 and 100."""
    return [
        {"debate_score": clip(f"50 + {flag('ma5 > ma10 AND ma10 > ma20', 10, -8)} + {flag('close > prior_high20', 10, -5)} + {flag('volume_ratio_prev >= 1.5', 6, -3)} + {flag('inflow_days >= 2', 8, -4)} + CASE WHEN pe > 100 THEN -6.0 WHEN pe > 0 AND pe < 50 THEN 3.0 ELSE 0.0 END + CASE WHEN pct_change > 7 THEN -8.0 WHEN pct_change > 0 THEN 3.0 ELSE 0.0 END", 0, 100)},
        {"verdict": "CASE WHEN debate_score >= 65 THEN 'recommend' WHEN debate_score >= 40 THEN 'watch' ELSE 'avoid' END"},
    ]


def gate() -> Layers:
    """The first failing gate decides bucket and reason; needs strategy, phase_forbidden, guard, volume, chase and entry columns."""
    tests = [
        ("strategy IS NULL AND guard_status = 'rejected'", "rejected", "guard"), ("strategy IS NULL", "watch", "trend_only"), ("phase_forbidden", "watch", "phase"), ("guard_status = 'rejected'", "rejected", "guard"), ("rps IS NULL", "watch", "rps_real"), ("strategy = 'leader' AND inflow_days = 0", "watch", "fund_flow"),
        ("volume_status = 'missing' OR volume_pattern IN ('breakout_without_volume', 'distribution_volume')", "watch", "volume"), ("entry IS NULL OR stop IS NULL", "watch", "entry"), ("chase_status = 'blocked'", "rejected", "anti_chase"), ("chase_status = 'watch'", "watch", "anti_chase"), ("close > entry * 1.08", "watch", "chase"), ("verdict = 'avoid'", "rejected", "debate"), ("guard_status = 'watch'", "watch", "guard_watch"),
    ]
    return [{"bucket": "CASE " + " ".join(f"WHEN {t} THEN '{b}'" for t, b, _ in tests) + " ELSE 'final' END", "gate": "CASE " + " ".join(f"WHEN {t} THEN '{g}'" for t, _, g in tests) + " ELSE 'passed' END"}]


#: Names of no board, what marks a board that is only an industry, and words of risk in news.
NO_BOARDS, INDUSTRY, RISK_WORDS = ("", "全市场强势", "观察池", "其他", "UNKNOWN", "None", "null"), "行业:", ("减持", "问询", "处罚", "立案", "退市", "澄清", "风险提示", "异常波动")
#: The parts of a pool score and their weights.
POOL_PARTS = {"market": 0.10, "board": 0.20, "price_volume": 0.25, "news": 0.15, "trade_plan": 0.15, "debate": 0.15}
#: Reasons that keep a stock out of the core, in the order of the gates, each with its test; those of OUT put it out altogether.
POOL_BLOCKERS = {
    "market_too_cold": "g_market = 'fail'", "board_mapping_missing": "g_board = 'missing'", "board_mapping_weak": "g_board = 'weak_mapping'", "price_volume_fail": "g_price_volume = 'fail'",
    "negative_news_risk": "g_news = 'fail'", "chasing_buy_point": "chasing", "trade_plan_fail": "g_trade_plan = 'fail' AND NOT chasing",
    "multi_agent_missing": "g_debate = 'missing'", "multi_agent_rejected": "g_debate = 'fail'", "multi_agent_low_confidence": "unsure",
}
OUT = ("negative_news_risk", "trade_plan_fail", "chasing_buy_point", "multi_agent_rejected")


def layered_pool(full: float = 75, trial: float = 62, min_rps: float = 70, min_confidence: float = 70, min_reward: float = 1.8, turnover: tuple[float, float] = (3, 18)) -> Layers:
    """Layered pool: six gates, each with a score (x_) and a state (g_), reasons against (`blockers`, in the order of the gates), the weighted score and the layer.

    core: a score of `full` and nothing against it, or (mode trial) `trial` where only the rules' own debate advises against and board, price and
    plan pass. pending: all but a debate, and at most 15 short. rejected: a reason of OUT. watch: the rest. Without a debate
    that is worth waiting for, its gate is not_scoped and says nothing against the stock.

    Columns: temperature, market_data and structured_data (degraded or not), board, board_top (one of the first five), board_hot (a hot theme is in its
    name), rps, pct_change, turnover_rate, volume_ratio_prev, n_hints, news_score, news_hot, n_news, news_risk, close, entry, entry_style, stop, target1,
    risk_reward, planned, debate_verdict (recommend, watch, avoid or null), debate_confidence, debate_by_rules."""
    names = ", ".join(f"'{x}'" for x in NO_BOARDS)
    low, high = turnover
    zero = lambda c: f"coalesce({c}, 0.0)"
    on = lambda test, points: f"CASE WHEN {test} THEN {float(points)} ELSE 0.0 END"
    turn, volume, pct, sure = zero("turnover_rate"), zero("volume_ratio_prev"), zero("pct_change"), zero("debate_confidence")
    buy, last = zero("entry"), zero("close")
    price = " + ".join([on(f"{zero('rps')} >= {min_rps}", 32), f"CASE WHEN {pct} BETWEEN 0 AND 9.2 THEN 20.0 WHEN {pct} >= -2 AND {pct} < 0 THEN 8.0 ELSE 0.0 END", f"CASE WHEN {turn} BETWEEN {low} AND {high} THEN 20.0 WHEN {turn} = 0 AND {volume} >= 1.5 THEN 12.0 ELSE 0.0 END", on(f"{volume} >= 1.5", 14), on("n_hints > 0", 14)])
    plan = " + ".join([on(f"{zero('risk_reward')} >= {min_reward}", 35), on(f"{buy} > 0 AND {zero('stop')} > 0 AND stop < entry", 25), on(f"{zero('target1')} > {buy}", 20), on(f"{last} <> 0 AND {buy} <> 0 AND entry <= close * 1.005", 10), on("entry_style IN ('ma_pullback', 'support_dip')", 10), on("planned", 10)])
    hard = [k for k in POOL_BLOCKERS if k not in ("multi_agent_missing", "multi_agent_low_confidence")]
    any_of = lambda keys: " OR ".join(f"k_{k}" for k in keys)
    against = ", ".join(f"CASE WHEN k_{k} THEN '{k}' END" for k in POOL_BLOCKERS)
    return [
        {"warm": "coalesce(temperature, 50.0)", "rule_side": "coalesce(debate_by_rules, false)", "chase_far": f"coalesce({buy} <> 0 AND {last} <> 0 AND entry > close * 1.01, false)", "chase_style": "coalesce(entry_style = 'breakout_confirm', false)"},
        {
            "x_market": f"CASE WHEN warm < 40 THEN 20.0 ELSE least(100.0, greatest(40.0, warm)) - {on("market_data = 'degraded'", 8)} - {on("structured_data = 'degraded'", 6)} END",
            "x_board": f"CASE WHEN coalesce(board, '') IN ({names}) THEN 35.0 WHEN board LIKE '{INDUSTRY}%' THEN 45.0 ELSE least(100.0, 55.0 + {on('board_top', 30)} + {on('board_hot', 15)}) END",
            "x_price_volume": f"least(100.0, {price})",
            "x_news": f"CASE WHEN news_risk THEN 15.0 ELSE coalesce(news_score, 50.0) + {on('news_hot', 18)} + {on('n_news > 0', 8)} END",
            "x_trade_plan": f"CASE WHEN chase_far THEN 20.0 WHEN chase_style THEN 25.0 ELSE least(100.0, {plan}) END", "chasing": "chase_far OR chase_style",
            "x_debate": f"CASE WHEN coalesce(debate_verdict, '') = '' THEN 0.0 WHEN debate_verdict = 'avoid' AND rule_side THEN least(35.0, greatest(20.0, {sure})) WHEN debate_verdict = 'avoid' THEN 10.0 WHEN debate_verdict <> 'recommend' THEN least(60.0, {sure}) WHEN {sure} < {min_confidence} THEN {sure} ELSE least(100.0, 70.0 + ({sure} - {min_confidence}) * 0.75) END",
            "unsure": f"coalesce(debate_verdict = 'recommend' AND {sure} < {min_confidence}, false)",
        },
        {
            "g_market": "CASE WHEN warm < 40 THEN 'fail' WHEN x_market >= 50 THEN 'pass' ELSE 'weak' END", "g_board": f"CASE WHEN coalesce(board, '') IN ({names}) THEN 'missing' WHEN board LIKE '{INDUSTRY}%' THEN 'weak_mapping' WHEN x_board >= 70 THEN 'pass' ELSE 'weak' END",
            "g_price_volume": "CASE WHEN x_price_volume < 55 THEN 'fail' ELSE 'pass' END", "g_news": "CASE WHEN news_risk THEN 'fail' WHEN x_news >= 55 THEN 'pass' ELSE 'neutral' END", "g_trade_plan": "CASE WHEN chasing OR x_trade_plan < 60 THEN 'fail' ELSE 'pass' END",
            "g_debate": f"CASE WHEN coalesce(debate_verdict, '') = '' THEN 'missing' WHEN debate_verdict = 'avoid' AND rule_side THEN 'rule_warn' WHEN debate_verdict = 'avoid' THEN 'fail' WHEN debate_verdict <> 'recommend' OR {sure} < {min_confidence} THEN 'weak' ELSE 'pass' END",
        },
        {"x_news": "CASE WHEN news_risk THEN x_news ELSE least(100.0, greatest(35.0, x_news)) END", "pool_score": "0.0", **{f"k_{k}": t for k, t in POOL_BLOCKERS.items()}},
        {"pool_score": clip(" + ".join(f"x_{k} * {w}" for k, w in POOL_PARTS.items()), 0, 100)},
        {"awaited": f"k_multi_agent_missing AND NOT ({any_of(hard)}) AND pool_score >= {full - 15}"},
        {"g_debate": "CASE WHEN k_multi_agent_missing AND NOT awaited THEN 'not_scoped' ELSE g_debate END", "k_multi_agent_missing": "awaited"},
        {"on_trial": f"g_debate = 'rule_warn' AND pool_score >= {trial} AND g_board = 'pass' AND g_price_volume = 'pass' AND g_trade_plan = 'pass' AND NOT ({any_of(POOL_BLOCKERS)})", "blockers": f"concat_ws(',', {against})"},
        {"pool_mode": f"CASE WHEN on_trial THEN 'trial' WHEN pool_score >= {full} AND blockers = '' THEN 'full' WHEN awaited THEN 'pending' WHEN {any_of(OUT)} THEN 'blocked' ELSE 'watch' END", "gates": "concat_ws(',', " + ", ".join(f"g_{k}" for k in POOL_PARTS) + ")"},
        {"pool_status": "CASE WHEN pool_mode IN ('trial', 'full') THEN 'core' WHEN pool_mode = 'pending' THEN 'pending' WHEN pool_mode = 'blocked' THEN 'rejected' ELSE 'watch' END"},
        # what waits for a debate is shown with what is watched
        {"pool_layer": "CASE WHEN pool_status = 'pending' THEN 'watch' ELSE pool_status END"},
    ]


#: Strategy pools: name to (test, score); each over the wide row.
POOLS = {
    # first_seal (HHMM), n_broken and seal_ratio (of the amount) may be null
    "limit_up": ("is_up", clip("50 + 8 * streak + CASE WHEN pct_change > 19 THEN 5 ELSE 0 END + CASE WHEN first_seal <= 930 THEN 15 WHEN first_seal <= 940 THEN 12 WHEN first_seal <= 1000 THEN 8 WHEN first_seal <= 1030 THEN 4 ELSE 0 END - 8 * coalesce(n_broken, 0) "
                               "+ CASE WHEN turnover_rate BETWEEN 3 AND 20 THEN 5 WHEN turnover_rate >= 1 AND turnover_rate < 3 THEN 2 WHEN turnover_rate > 30 THEN -5 ELSE 0 END + CASE WHEN seal_ratio > 0.1 THEN 5 ELSE 0 END", 20, 95)),
    "trend_pullback": ("rn >= 30 AND rps >= 60 AND turnover_rate >= 1 AND (close > ma20 * 0.95 AND close < ma20 * 1.03 OR close > ma20 * 1.05 AND prev_close <= ma20 * 1.05)", f"least(90.0, rps * 0.8 + {flag('close > ma20 * 0.95 AND close < ma20 * 1.03', 10)} + {flag('close > ma20 * 1.05 AND prev_close <= ma20 * 1.05', 10)} + {flag('volume_ratio_incl < 1.1', 5)})"),
    "oversold_rebound": ("rn >= 30 AND ret19 * 100 <= -15 AND (volume < volume_mean10 * 0.8 OR (high - low) / prev_close > 2 * abs(close - prev_close) / prev_close AND close > (high + low) / 2)", f"least(88.0, abs(ret19 * 100) * 1.5 + {flag('(high - low) / prev_close > 2 * abs(close - prev_close) / prev_close AND close > (high + low) / 2', 10)} + {flag('volume < volume_mean10 * 0.8', 5)})"),
    "small_quality": ("circ_mv_yi <= 200 AND turnover_rate >= 2 AND profit >= 0", "least(85.0, 50 + 0.2 * (100 - circ_mv_yi) + 2 * turnover_rate)"),
    "large_low_vol": ("circ_mv_yi >= 300 AND vol60 <= {max_vol}", "least(80.0, 60 - vol60 / {vol_unit})"),
    "leader": ("is_up AND theme_place <= 3 AND streak >= 1", "least(98.0, 60 + theme_strength * 2 + streak * 5 + CASE WHEN streak = theme_top AND streak >= 2 THEN 15 WHEN circ_mv_yi >= theme_median * 1.2 THEN 10 WHEN streak >= 2 THEN 5 ELSE 0 END)"),
}


def pools(max_vol: float = 35.0, vol_unit: float = 1.0) -> dict[str, tuple[str, str]]:
    return {k: (t.format(max_vol=max_vol, vol_unit=vol_unit), s.format(max_vol=max_vol, vol_unit=vol_unit)) for k, (t, s) in POOLS.items()}


def run_pools(wide: DataFrame, rules: dict[str, tuple[str, str]], size: int = 15) -> DataFrame:
    """pool, code, score, place: the best `size` of each pool, in one pass over the stocks."""
    hits = F.array(*[F.struct(F.lit(k).alias("pool"), F.expr(f"CASE WHEN {t} THEN {s} END").cast("double").alias("score")) for k, (t, s) in rules.items()])
    long = wide.select("code", F.explode(hits).alias("x")).select("code", "x.*").where("score IS NOT NULL")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("score"), "code"))).where(F.col("place") <= size)


def event_pool(dragon: DataFrame, spot: DataFrame, announcements: DataFrame, negative: str, positive: str, first: int = 50) -> DataFrame:
    """code, score: stocks on the dragon-tiger list (75 bought net, else 70), and of the first gainers of 5 per cent those whose latest announcement is positive (72) or negative (40)."""
    listed = dragon.groupBy("code").agg(F.max("net").alias("net")).select("code", F.when(F.col("net") > 0, 75.0).otherwise(70.0).alias("score"))
    hot = spot.where("pct_change >= 5").orderBy(F.desc("pct_change"), "code").limit(first)
    last = announcements.groupBy("code").agg(F.max_by("title", "ts").alias("title"))
    told = hot.join(last, "code").select("code", F.when(F.col("title").rlike(negative), 40.0).when(F.col("title").rlike(positive), 72.0).alias("score")).where("score IS NOT NULL")
    return listed.unionByName(told).groupBy("code").agg(F.max("score").alias("score"))
