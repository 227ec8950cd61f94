"""Stock-level queries: scores, pools, guards, plans and gates, on one wide row per stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import emotion_factor
from barlattice.operators import market as m
from barlattice.operators import rules
from barlattice.operators import windows as w
from barlattice.plans.common import Catalogue, layered, r, with_ctes
from barlattice.plans.market import DAY, DOWN, POOL, SCALE, TEMP, UP, temperature
from barlattice.scratch import stored
from barlattice.sources import adapters as a

CATALOGUE = Catalogue()
add = CATALOGUE.add
#: Limits that suit these tables, whose changes and deviations are far wider than a stock's.
TREND = rules.trend_score(hard_min=50, strong=70, cap=(30, 500))
POOL_RULES = rules.pools(max_vol=60_000.0, vol_unit=1_000.0)
VALUE = {"pe": "CASE WHEN profit > 0 THEN circ_mv_yi * 100 / profit END", "pb": "circ_mv_yi / 50", "strategy": "CASE WHEN is_up THEN 'leader' WHEN rps >= 80 THEN 'trend_pullback' WHEN rps <= 20 THEN 'oversold_rebound' WHEN rps >= 30 THEN 'limit_up' END", "phase_forbidden": "streak >= 3", "emotion": "0.7", "board_gap": "rps - avg_rps"}
BASE = [VALUE, *rules.volume_audit(), *rules.anti_chase(), *rules.quant_guard(), *rules.entry_exit()]
#: Stand-ins for inputs that these tables have no source for: factors from flows, ranks and changes, news from the theme; the rest is null.
GIVEN = {
    "lhb_net_wan": "CASE WHEN is_up THEN pct_change * 20 - 9000 END", "hot_rank": "CAST(theme_place * 8 AS DOUBLE)", "flow20": "(inflow_days - 1) * 60000000.0", "north5": "(rps - 50) * 2000000.0", "margin5": "CASE WHEN ret5 > 0 THEN ret5 * 100000000.0 END",
    "n_research": "CASE WHEN rps > 90 THEN 1 END", "unlock_ratio": "CASE WHEN debt_ratio > 80 THEN (debt_ratio - 80) / 4 END", "n_ann_risks": "CASE WHEN profit < 0 THEN 1 ELSE 0 END", "n_block_trades": "CASE WHEN turnover_rate > 9 THEN 1 ELSE 0 END", "holder_qoq": "debt_ratio / 5 - 10",
    "news_score": "CASE WHEN theme_strength IS NOT NULL THEN 40 + rps * 0.5 END", "news_theme": "CASE WHEN theme_place <= 5 THEN concat('market > hot > ', board) END", "golden_cross": "ma5 > ma20 AND prev_close <= ma20", "n_flags": "CASE WHEN chase_status = 'watch' THEN 1 ELSE 0 END + CASE WHEN volume_status = 'watch' THEN 1 ELSE 0 END",
    "cal_prob": "CASE WHEN rps > 95 THEN rps / 150.0 END", "cal_ret": "CASE WHEN rps > 95 THEN ret5 / 10 END", "cal_flag": "CASE WHEN rps > 95 THEN 'low' END",
}
#: What each kind of query needs, and no more: the layers of one query end in one generated function.
SCORED = [*TREND, *BASE, GIVEN, *rules.structured(), *rules.news_bonus(), *rules.recommendation()]
GATED = [*BASE, *rules.debate(), *rules.gate()]

SHRINK = "close > lag(close) OVER c AND lag(close) OVER c > lag(close, 2) OVER c AND lag(close, 2) OVER c > lag(close, 3) OVER c AND volume < lag(volume) OVER c AND lag(volume) OVER c < lag(volume, 2) OVER c AND close / lag(close, 3) OVER c - 1 > 0.15"
WIDE_SQL = with_ctes("rps", "flows", "stocks", "ch", more=POOL + f""",
days AS (SELECT code, trade_date, CASE WHEN main_net > 0 THEN count(*) FILTER (main_net > 0) OVER (PARTITION BY code, island ORDER BY trade_date) ELSE 0 END AS inflow_days FROM (SELECT *, sum(CASE WHEN main_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY trade_date) AS island FROM flows)),
shr AS (SELECT code, trade_date, {SHRINK} AS shrinking FROM bars WINDOW c AS (PARTITION BY code ORDER BY trade_date)),
th AS (SELECT *, row_number() OVER (ORDER BY theme_strength DESC, board) AS theme_place FROM (SELECT board, count(*) + 0.5 * CAST(sum(streak) AS BIGINT) AS theme_strength, max(streak) AS theme_top, median(circ_mv_yi) AS theme_median FROM pool JOIN stocks USING (code) WHERE is_up AND trade_date <= {DAY} AND trade_date > {DAY} - 60 GROUP BY 1)),
wide AS (SELECT x.*, s.name, s.board, s.profit, s.circ_mv_yi, s.debt_ratio, x.volume / 10 AS turnover_rate, d.inflow_days, p.streak, p.is_up, shr.shrinking, th.theme_strength, th.theme_top, th.theme_median, th.theme_place, avg(x.rps) OVER (PARTITION BY s.board) AS avg_rps, CAST(NULL AS INTEGER) AS first_seal, CAST(NULL AS INTEGER) AS n_broken, CAST(NULL AS DOUBLE) AS seal_ratio
  FROM (SELECT * FROM rps WHERE trade_date <= {DAY} QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1) x JOIN stocks s USING (code) JOIN days d USING (code, trade_date) JOIN pool p USING (code, trade_date) JOIN shr USING (code, trade_date) LEFT JOIN th ON th.board = s.board)""")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a market measure looks at of every bar up to the day, written once: code, trade_date, ret20, the pools' columns (of pct_change the sign), newest (the code's last row with a ret20)."""
    p = m.pool(w.features(a.bars(spark, sf_dir).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date"))), UP, DOWN)
    last = F.max(F.when(F.col("ret20").isNotNull(), F.col("trade_date"))).over(Window.partitionBy("code"))
    return stored(p.select("code", "trade_date", "ret20", F.signum("pct_change").alias("pct_change"), "is_up", "is_down", "is_broke", "streak", F.coalesce(last == F.col("trade_date"), F.lit(False)).alias("newest")), "marks")


def wide(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """The last row of each stock up to the day, with everything that the rules look at. Features stay where their code is and are cut to one row per code there; what needs a whole day comes from marks (seen), and of those only the days of such rows are ranked."""
    seen = marks(spark, sf_dir) if seen is None else seen
    o = a.by_code()
    lag = lambda c, n: F.lag(c, n).over(o)
    shrink = (F.col("close") > lag("close", 1)) & (lag("close", 1) > lag("close", 2)) & (lag("close", 2) > lag("close", 3)) & (F.col("volume") < lag("volume", 1)) & (lag("volume", 1) < lag("volume", 2)) & (F.col("close") / lag("close", 3) - 1 > 0.15)
    series = m.pool(w.features(a.bars_and_flows(spark, sf_dir).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date"))).withColumn("shrinking", shrink), UP, DOWN)
    rows = w.streak(series, F.col("main_net") > 0, "inflow_days").where("ret20 IS NOT NULL")
    x = rows.withColumn("_next", F.lead(F.lit(1)).over(o)).where("_next IS NULL").drop("_next", "is_down", "is_broke", "main_net")
    days = seen.where("newest").select("trade_date").distinct()  # no more rows than days of the calendar
    ranks = w.rps(seen.select("code", "trade_date", "ret20", "newest").join(F.broadcast(days), "trade_date", "left_semi")).where("newest").select("code", "rps")
    hot = seen.where(F.col("is_up") & (F.col("trade_date") > F.date_sub(F.lit(a.AS_OF).cast("date"), 60))).join(a.stocks(spark, sf_dir), "code")
    themes = m.theme_strength(hot, "board").select("board", F.col("strength").cast("double").alias("theme_strength"), F.col("top_streak").alias("theme_top"), F.col("median_cap").alias("theme_median"), F.col("place").alias("theme_place"))
    out = x.join(ranks, "code").join(a.stocks(spark, sf_dir), "code").join(themes, "board", "left")
    unknown = {"first_seal": F.lit(None).cast("int"), "n_broken": F.lit(None).cast("int"), "seal_ratio": F.lit(None).cast("double")}
    return out.withColumn("turnover_rate", F.col("volume") / 10).withColumn("avg_rps", F.avg("rps").over(Window.partitionBy("board"))).withColumns(unknown)


def ruled(name: str, layers: rules.Layers, columns: dict[str, int | None], where: str = "true") -> None:
    """A query of columns that layers of rules give; columns: name to digits, None for what isn't rounded."""
    picked = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) AS {c}" if d is not None else c for c, d in columns.items())
    add(name, WIDE_SQL + f"SELECT code, {picked} FROM {layered('wide', layers)} WHERE {where}")(lambda spark, sf_dir: rules.derive(wide(spark, sf_dir), layers).where(where).select("code", *[r(F.col(c).cast("double"), d, c) if d is not None else F.col(c) for c, d in columns.items()]))


ruled("trend_evaluate", TREND, {"rps": 6, "trend_points": 2, "order_key": 4}, "selected")
ruled("volume_audit", BASE, {"volume_ratio_prev": 6, "volume_pattern": None, "volume_status": None, "volume_anomaly": None, "obv_label": None})
ruled("anti_chase", BASE, {"strategy": None, "dist5": 6, "dist20": 6, "chase_status": None})
ruled("quant_guard", BASE, {"guard_reason": None, "guard_status": None})
ruled("entry_exit_plan", BASE, {"entry": 8, "entry_style": None, "n_points": 0, "stop": 8, "stop_method": None, "target1": 4, "target2": 4, "risk_reward": 4})
ruled("position_size", [*BASE, *rules.position()], {"shares": 0, "risk_pct": 6})
ruled("recommendation_score", [*SCORED, *rules.outlook()], {"s_trend": 4, "s_fund": 4, "s_pattern": 4, "s_rr": 4, "s_control": 4, "recommend_score": 4, "grade": None, "confidence": 4})
ruled("structured_factors", [*BASE, GIVEN, *rules.structured()], {"structured_score": 4, "structured_bonus": 2, "structured_penalty": 2})
ruled("news_resonance", [*BASE, GIVEN, *rules.news_bonus()], {"theme_word": None, "news_bonus": 4})
ruled("outlook_band", [*SCORED, *rules.outlook()], {"calibrated": None, "confidence": 4, "target_low": 1, "target_high": 1})
ruled("recommendation_tags", [*SCORED, *rules.tags()], {"s_momentum": 4, "tag": None})
ruled("rule_debate", [*BASE, *rules.debate()], {"debate_score": 2, "verdict": None})
ruled("gate_decision", GATED, {"strategy": None, "bucket": None, "gate": None})
#: What the layered pool looks at, where these tables have a source or a stand-in for it; the debate is the rules' own, and missing for some.
POOL_GIVEN = {
    "market_data": "CASE WHEN turnover_rate IS NULL THEN 'degraded' ELSE 'ok' END", "structured_data": "CASE WHEN profit IS NULL THEN 'degraded' ELSE 'ok' END", "board_top": "coalesce(theme_place <= 5, false)", "board_hot": "coalesce(theme_place <= 12, false)",
    "n_hints": "CASE WHEN ma5 > ma10 THEN 1 ELSE 0 END + CASE WHEN close > prior_high20 THEN 1 ELSE 0 END", "news_hot": "coalesce(theme_place <= 3, false)", "n_news": "coalesce(theme_place, 0)", "news_risk": "coalesce(profit < 0, false)", "planned": "entry > stop",
    "debate_verdict": "CASE WHEN rps >= 20 THEN verdict END", "debate_confidence": "debate_score", "debate_by_rules": "rps < 70",
}
POOLED = [*BASE, *rules.debate(), {"news_score": GIVEN["news_score"]}, POOL_GIVEN, *rules.layered_pool()]
DAYS_SQL = WIDE_SQL.rstrip() + TEMP.removeprefix(POOL) + ", warm_wide AS (SELECT w.*, t.temperature FROM wide w LEFT JOIN (SELECT trade_date, temperature FROM tp) t USING (trade_date)) "


def warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows with their day's market temperature."""
    seen = marks(spark, sf_dir)
    days = m.temperature(m.daily_pool(seen), SCALE).select("trade_date", "temperature")
    return wide(spark, sf_dir, seen).join(F.broadcast(days), "trade_date", "left")  # a row per day


@add("layered_pool", DAYS_SQL + "SELECT code, " + ", ".join(f"round(CAST(x_{k} AS DOUBLE), 4) AS x_{k}" for k in rules.POOL_PARTS) + f", round(CAST(pool_score AS DOUBLE), 4) AS pool_score, gates, blockers, pool_mode, pool_status FROM {layered('warm_wide', POOLED)}")
def layered_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.derive(warm(spark, sf_dir), POOLED)
    return x.select("code", *[r(F.col(f"x_{k}").cast("double"), 4, f"x_{k}") for k in rules.POOL_PARTS], r(F.col("pool_score").cast("double"), 4, "pool_score"), "gates", "blockers", "pool_mode", "pool_status")


@add("pool_blockers", DAYS_SQL + f"SELECT blocker, count(*) AS n FROM (SELECT unnest(string_split(blockers, ',')) AS blocker FROM {layered('warm_wide', POOLED)}) WHERE blocker <> '' GROUP BY 1 ORDER BY n DESC, blocker LIMIT 10")
def pool_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.derive(warm(spark, sf_dir), POOLED).select(F.explode(F.split("blockers", ",")).alias("blocker")).where("blocker <> ''")
    return x.groupBy("blocker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "blocker").limit(10)


@add("strategy_pools", WIDE_SQL + "SELECT pool, code, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, code) AS place FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pool, code, CAST({s} AS DOUBLE) AS score FROM wide WHERE {t}" for k, (t, s) in POOL_RULES.items()) + ")) WHERE place <= 15")
def strategy_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_pools(wide(spark, sf_dir), POOL_RULES).select("pool", "code", r("score", 4), "place")


#: The gate's layers over rows whose strategy comes from the pools' signals.
SIGNALLED = [{k: x for k, x in VALUE.items() if k != "strategy"}, *GATED[1:]]
SIGNALS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS pool, code, CAST({s} AS DOUBLE) AS score FROM wide WHERE {t}" for k, (t, s) in POOL_RULES.items())


@add("gate_outer", WIDE_SQL.rstrip() + f""", sg AS (SELECT code, arg_max(pool, (score, pool)) AS strategy, max(score) AS signal FROM (SELECT * FROM ({SIGNALS_SQL}) QUALIFY row_number() OVER (PARTITION BY pool ORDER BY score DESC, code) <= 15) GROUP BY 1),
cand AS (SELECT code, trend_points FROM {layered('wide', TREND)} WHERE selected), both_sides AS (SELECT coalesce(sg.code, cand.code) AS code, strategy, signal, trend_points FROM sg FULL JOIN cand ON sg.code = cand.code), given AS (SELECT wide.*, strategy, signal, trend_points AS scan_points FROM both_sides JOIN wide USING (code))
SELECT code, strategy, round(signal, 4) AS signal, round(CAST(scan_points AS DOUBLE), 4) AS scan_points, bucket, gate FROM {layered('given', SIGNALLED)}""")
def gate_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the full outer join of the pools' best signals and the scan's candidates: codes of signals alone are judged as those of both, codes of the scan alone stay out of the final ones."""
    x = stored(wide(spark, sf_dir), "wide")
    hits = rules.run_pools(x, POOL_RULES)
    signals = hits.groupBy("code").agg(F.max_by("pool", F.struct("score", "pool")).alias("strategy"), F.max("score").alias("signal"))
    scanned = rules.derive(x, TREND).where("selected").select("code", F.col("trend_points").alias("scan_points"))
    rows = signals.join(scanned, "code", "full").join(x, "code")
    return rules.derive(rows, SIGNALLED).select("code", "strategy", r("signal", 4), r(F.col("scan_points").cast("double"), 4, "scan_points"), "bucket", "gate")


@add("broad_watch_pool", with_ctes("spot", more="s AS (SELECT *, avg(CASE WHEN circ_mv_yi > 0 THEN 1.0 ELSE 0.0 END) OVER () AS valid FROM spot)") + "SELECT code, round(pct_change, 6) AS pct_change, round(least(99, greatest(40, 50 + 2 * pct_change)), 6) AS proxy_rps FROM (SELECT * FROM s WHERE pct_change >= 1 AND (valid <= 0.5 OR circ_mv_yi BETWEEN 30 AND 500) AND code NOT IN (SELECT code FROM spot WHERE pct_change BETWEEN 0.5 AND 9.8) ORDER BY pct_change DESC, code LIMIT 30)")
def broad_watch_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = a.spot(spark, sf_dir)
    seen = s.where(F.col("pct_change").between(0.5, 9.8)).select("code")
    valid = s.crossJoin(F.broadcast(s.agg(F.avg(F.when(F.col("circ_mv_yi") > 0, 1.0).otherwise(0.0)).alias("valid"))))  # one row
    left = valid.where((F.col("pct_change") >= 1) & ((F.col("valid") <= 0.5) | F.col("circ_mv_yi").between(30, 500))).join(seen, "code", "left_anti")
    return left.orderBy(F.desc("pct_change"), "code").limit(30).select("code", r("pct_change"), r(F.least(F.lit(99.0), F.greatest(F.lit(40.0), 50 + 2 * F.col("pct_change"))), alias="proxy_rps"))


@add("block_reasons", WIDE_SQL + f"SELECT gate, bucket, count(*) AS n FROM {layered('wide', GATED)} WHERE bucket <> 'final' GROUP BY 1, 2")
def block_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the test needs the count, so it stays above the aggregate and the rules are evaluated once
    return rules.derive(wide(spark, sf_dir), GATED).groupBy("gate", "bucket").agg(F.count(F.lit(1)).alias("n")).where("CASE WHEN bucket <> 'final' THEN n ELSE 0 END > 0")


@add("emotion_factors", with_ctes("ch", more=TEMP) + "SELECT trade_date, round(i, 4) AS temperature, round(CASE WHEN i <= 40 THEN 0.0 WHEN i <= 50 THEN (i - 40) / 10.0 * 0.4 WHEN i <= 70 THEN 0.4 + (i - 50) / 20.0 * 0.6 WHEN i <= 85 THEN 1.0 - (i - 70) / 15.0 * 0.4 WHEN i <= 95 THEN 0.6 - (i - 85) / 10.0 * 0.3 ELSE 0.3 END, 6) AS factor FROM (SELECT trade_date, temperature AS i FROM tp)")
def emotion_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position factor of every market day, from its temperature."""
    return temperature(spark, sf_dir).select("trade_date", r("temperature", 4), r(emotion_factor(F.col("temperature")), alias="factor"))
