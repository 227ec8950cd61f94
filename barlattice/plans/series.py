"""Per-stock time-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.operators import windows as w
from barlattice.operators.ranking import numbered, percentile, ranked
from barlattice.operators.scans import macd, prior_percentiles
from barlattice.plans.common import Catalogue, r, with_ctes
from barlattice.sources import adapters as a

CATALOGUE = Catalogue()
add = CATALOGUE.add
KEY = ["code", "trade_date"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.features(a.bars(spark, sf_dir))


def plain(name: str, columns: dict[str, str], where: str = "true", digits: int = 6) -> None:
    """A query of feature columns, rounded. columns: output name to expression, the same in Spark's SQL and DuckDB's."""
    sql = with_ctes("feat") + "SELECT code, trade_date, " + ", ".join(f"round({e}, {digits}) AS {n}" for n, e in columns.items()) + f" FROM feat WHERE {where}"
    add(name, sql)(lambda spark, sf_dir: features(spark, sf_dir).where(where).select(*KEY, *[F.round(F.expr(e), digits).alias(n) for n, e in columns.items()]))


plain("ma_features", {"ma5": "ma5", "ma10": "ma10", "ma20": "ma20", "ma60": "ma60"})
plain("n_row_returns", {"ret3": "ret3", "ret5": "ret5", "ret10": "ret10", "ret19": "ret19", "ret20": "ret20"})
plain("breakout_volume", {"prior_high20": "prior_high20", "volume_ratio_incl": "volume_ratio_incl", "volume_ratio_prev": "volume_ratio_prev", "amount_ratio5": "amount_ratio5"}, "close > prior_high20 AND prior_n = 20")
plain("atr14", {"tr": "tr", "atr14": "atr14"}, "rn >= 15", 8)
plain("obv_trend", {"obv": "obv", "obv5": "obv5", "trend": "sign(obv5)"})
plain("recent_extremes", {"recent_high20": "recent_high20", "recent_low20": "recent_low20"}, digits=8)


@add("rps_rank", with_ctes("rps") + "SELECT code, trade_date, round(ret20, 6) AS ret20, round(rps, 6) AS rps FROM rps")
def rps_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.rps(features(spark, sf_dir)).select(*KEY, r("ret20"), r("rps"))


@add("volatility_rank", with_ctes("feat") + f"SELECT *, row_number() OVER (ORDER BY vol60, code) AS place FROM (SELECT code, round(arg_max(vol60, trade_date), 4) AS vol60 FROM feat WHERE vol60 IS NOT NULL AND trade_date <= DATE '{a.AS_OF}' GROUP BY 1)")
def volatility_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where(F.col("vol60").isNotNull() & (F.col("trade_date") <= F.lit(a.AS_OF).cast("date")))
    last = f.groupBy("code").agg(F.round(F.max_by("vol60", "trade_date"), 4).alias("vol60"))
    return numbered(last, [F.asc("vol60"), F.asc("code")])


@add("return_percentile", with_ctes("feat") + """SELECT code, trade_date, r6 AS ret20, rank() OVER (ORDER BY r6) AS rank, round((rank() OVER (ORDER BY r6) + (count(*) OVER (PARTITION BY r6) - 1) / 2) / count(*) OVER () * 100, 6) AS percentile
FROM (SELECT code, trade_date, round(ret20, 3) AS r6 FROM feat WHERE ret20 IS NOT NULL)""")
def return_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each 20-row return stands among those of all stocks and days; returns of three digits, so ties are long."""
    ranks = ranked(features(spark, sf_dir).where("ret20 IS NOT NULL").select(*KEY, r("ret20", 3)), "ret20")
    return ranks.select(*KEY, "ret20", "rank", r(percentile(F.col("rank"), F.col("ties"), F.col("of")), alias="percentile"))


def trend_sql(n: int) -> str:
    return f"""close / lag(close, {n}) OVER c * 100 - 100 AS change{n}, close / max(high) OVER (c ROWS {n - 1} PRECEDING) * 100 - 100 AS pullback{n}, close / min(low) OVER (c ROWS {n - 1} PRECEDING) * 100 - 100 AS rebound{n}"""


def state_sql(n: int) -> str:
    return f"CASE WHEN change{n} IS NULL THEN NULL WHEN change{n} > 5 AND pullback{n} > -5 THEN 'rising' WHEN change{n} < -5 THEN 'falling' WHEN rebound{n} > 8 THEN 'rebounding' ELSE 'sideways' END AS state{n}"


@add("trend_windows", with_ctes("bars") + "SELECT code, trade_date, " + ", ".join(f"round(change{n}, 4) AS change{n}, round(pullback{n}, 4) AS pullback{n}, round(rebound{n}, 4) AS rebound{n}, {state_sql(n)}" for n in (5, 10, 20)) + " FROM (SELECT code, trade_date, " + ", ".join(trend_sql(n) for n in (5, 10, 20)) + " FROM bars WINDOW c AS (PARTITION BY code ORDER BY trade_date))")
def trend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.bars(spark, sf_dir)
    for n in (5, 10, 20):
        t = w.trend_windows(b, n)
        b = b.withColumns({k: c for k, c in t.items() if not k.startswith("state")}).withColumn(f"state{n}", t[f"state{n}"])
    return b.select(*KEY, *[r(f"{k}{n}", 4) for n in (5, 10, 20) for k in ("change", "pullback", "rebound")], *[f"state{n}" for n in (5, 10, 20)])


@add("inflow_streak", with_ctes("flows") + """SELECT code, trade_date, main_net, CASE WHEN main_net > 0 THEN count(*) OVER (PARTITION BY code, island ORDER BY trade_date) - min(skip) OVER (PARTITION BY code, island) ELSE 0 END AS inflow_days
FROM (SELECT *, CASE WHEN main_net > 0 THEN 0 ELSE 1 END AS off, sum(CASE WHEN main_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY trade_date) AS island, CASE WHEN sum(CASE WHEN main_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY trade_date) = 0 THEN 0 ELSE 1 END AS skip FROM flows)""")
def inflow_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.streak(a.flows(spark, sf_dir), F.col("main_net") > 0, "inflow_days").select(*KEY, "main_net", F.col("inflow_days").cast("long"))


@add("shrink_accel", with_ctes("bars") + """SELECT code, trade_date, round(close / c3 - 1, 6) AS ret3 FROM (SELECT *, lag(close) OVER c AS c1, lag(close, 2) OVER c AS c2, lag(close, 3) OVER c AS c3, lag(volume) OVER c AS v1, lag(volume, 2) OVER c AS v2 FROM bars WINDOW c AS (PARTITION BY code ORDER BY trade_date))
WHERE close > c1 AND c1 > c2 AND volume < v1 AND v1 < v2 AND close / c3 - 1 > 0.15""")
def shrink_accel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.by_code()
    b = a.bars(spark, sf_dir).withColumns({**{f"c{n}": F.lag("close", n).over(o) for n in (1, 2, 3)}, **{f"v{n}": F.lag("volume", n).over(o) for n in (1, 2)}})
    return b.where("close > c1 AND c1 > c2 AND volume < v1 AND v1 < v2 AND close / c3 - 1 > 0.15").select(*KEY, F.expr("round(close / c3 - 1, 6)").alias("ret3"))


DAILY = "daily AS (SELECT trade_date, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (pct_change > 0) AS DOUBLE) AS advance FROM ch WHERE pct_change IS NOT NULL GROUP BY 1)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day: a few thousand rows at any scale, so its windows may run in one task."""
    c = a.changes(a.bars(spark, sf_dir)).where("pct_change IS NOT NULL")
    return c.groupBy("trade_date").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("pct_change") > 0).cast("double").alias("advance"))


@add("prior_window_percentile", with_ctes("ch", more=DAILY) + "SELECT trade_date, advance, " + ", ".join(f"CASE WHEN len(l{n}) >= 5 THEN round(len(list_filter(l{n}, lambda x: x < advance)) / len(l{n}) * 100, 1) END AS pct{n}" for n in (60, 250)) + " FROM (SELECT *, " + ", ".join(f"list(advance) OVER (ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS l{n}" for n in (60, 250)) + " FROM daily)")
def prior_window_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior_percentiles(daily(spark, sf_dir).withColumn("field", F.lit("advance")), "field", "trade_date", "advance", (60, 250)).drop("field")


@add("close_percentile", with_ctes("bars") + "SELECT code, trade_date, close, " + ", ".join(f"CASE WHEN len(l{n}) >= 5 THEN round(len(list_filter(l{n}, lambda x: x < close)) / len(l{n}) * 100, 1) END AS pct{n}" for n in (60, 250)) + " FROM (SELECT *, " + ", ".join(f"list(close) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS l{n}" for n in (60, 250)) + " FROM bars)")
def close_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each close stands among the 60 and 250 closes of its stock before it."""
    return prior_percentiles(a.bars(spark, sf_dir), "code", "trade_date", "close", (60, 250))


@add("roc_momentum", with_ctes("ch", more=DAILY) + "SELECT trade_date, round(roc5, 6) AS roc5, round(roc10, 6) AS roc10, round(roc5 - roc10, 6) AS accel FROM (SELECT trade_date, " + ", ".join(f"(advance - lag(advance, {n}) OVER c) / nullif(abs(lag(advance, {n}) OVER c), 0) * 100 AS roc{n}" for n in (5, 10)) + " FROM daily WINDOW c AS (ORDER BY trade_date))")
def roc_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).select("trade_date", *[w.rate_of_change("advance", "trade_date", n).alias(f"roc{n}") for n in (5, 10)])
    return d.select("trade_date", r("roc5"), r("roc10"), r(F.col("roc5") - F.col("roc10"), alias="accel"))


@add("breadth_trend_label", with_ctes("ch", more=DAILY) + "SELECT trade_date, CASE WHEN p2 IS NULL THEN 'flat' WHEN advance > p1 AND p1 > p2 THEN 'up' WHEN advance < p1 AND p1 < p2 THEN 'down' ELSE 'flat' END AS label FROM (SELECT *, lag(advance) OVER (ORDER BY trade_date) AS p1, lag(advance, 2) OVER (ORDER BY trade_date) AS p2 FROM daily)")
def breadth_trend_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Window.orderBy("trade_date")
    d = daily(spark, sf_dir).withColumn("p1", F.lag("advance", 1).over(o)).withColumn("p2", F.lag("advance", 2).over(o))
    return d.select("trade_date", F.expr("CASE WHEN p2 IS NULL THEN 'flat' WHEN advance > p1 AND p1 > p2 THEN 'up' WHEN advance < p1 AND p1 < p2 THEN 'down' ELSE 'flat' END").alias("label"))


def forward_sql(h: int) -> str:
    frame = f"(c ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(close) OVER {frame} = {h} THEN round(lead(close, {h}) OVER c / close - 1, 6) END AS fwd_ret{h}, CASE WHEN count(close) OVER {frame} = {h} THEN round(max(high) OVER {frame} / close - 1, 6) END AS fwd_high{h}, CASE WHEN count(close) OVER {frame} = {h} THEN round(min(low) OVER {frame} / close - 1, 6) END AS fwd_low{h}, CASE WHEN count(close) OVER {frame} = {h} THEN CASE WHEN lead(close, {h}) OVER c > close THEN 1 ELSE 0 END END AS fwd_win{h}"


@add("forward_returns", with_ctes("bars") + "SELECT code, trade_date, " + ", ".join(forward_sql(h) for h in (1, 3, 5, 10)) + " FROM bars WINDOW c AS (PARTITION BY code ORDER BY trade_date)")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {k: c for h in (1, 3, 5, 10) for k, c in w.forward(h).items()}
    return a.bars(spark, sf_dir).select(*KEY, *[c.alias(k) if "win" in k else r(c, alias=k) for k, c in cols.items()])


@add("equity_metrics", with_ctes("bars") + """, m AS (SELECT code, arg_min(close, trade_date) AS f, arg_max(close, trade_date) AS l, date_diff('day', min(trade_date), max(trade_date)) AS days, max(1 - close / peak) AS dd, avg(daily) AS mean, stddev_pop(daily) AS sd
FROM (SELECT *, close / lag(close) OVER c - 1 AS daily, max(close) OVER (c ROWS UNBOUNDED PRECEDING) AS peak FROM bars WINDOW c AS (PARTITION BY code ORDER BY trade_date)) GROUP BY 1)
SELECT code, round(l / f - 1, 6) AS total_return, CASE WHEN days > 0 THEN round(pow(1 + greatest(l / f - 1, -0.9999), 365.25 / days) - 1, 6) END AS annual_return, round(dd, 6) AS max_drawdown, round(mean / nullif(sd, 0) * sqrt(252), 6) AS sharpe FROM m""")
def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.equity_metrics(a.bars(spark, sf_dir)).select("code", r("total_return"), r("annual_return"), r("max_drawdown"), r("sharpe"))


@add("monthly_returns", with_ctes("bars") + "SELECT code, month, round(last / lag(last) OVER (PARTITION BY code ORDER BY month) - 1, 6) AS month_return FROM (SELECT code, strftime(trade_date, '%Y-%m') AS month, arg_max(close, trade_date) AS last FROM bars GROUP BY 1, 2)")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.bars(spark, sf_dir).groupBy("code", F.date_format("trade_date", "yyyy-MM").alias("month")).agg(F.max_by("close", "trade_date").alias("last"))
    return m.select("code", "month", r(F.try_divide("last", F.lag("last").over(Window.partitionBy("code").orderBy("month"))) - 1, alias="month_return"))


@add("benchmark_curve", with_ctes("bars") + "SELECT code, trade_date, round(close / first_value(close) OVER (PARTITION BY code ORDER BY trade_date), 6) AS nav FROM bars")
def benchmark_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.bars(spark, sf_dir).select(*KEY, r(F.try_divide(F.col("close"), F.first("close").over(a.by_code())), alias="nav"))


@add("asof_spot", with_ctes("spot") + "SELECT code, trade_date, close, round(pct_change, 6) AS pct_change, board, circ_mv_yi FROM spot")
def asof_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.spot(spark, sf_dir).select(*KEY, "close", r("pct_change"), "board", "circ_mv_yi")


@add("next_bar", with_ctes("bars") + f"SELECT code, min(trade_date) AS next_date, arg_min(open, trade_date) AS next_open FROM bars WHERE trade_date > DATE '{a.AS_OF}' GROUP BY 1")
def next_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = a.bars(spark, sf_dir).where(F.col("trade_date") > F.lit(a.AS_OF).cast("date"))
    return later.groupBy("code").agg(F.min("trade_date").alias("next_date"), F.min_by("open", "trade_date").alias("next_open"))


@add("ewma_macd", with_ctes("bars") + """
SELECT code, round(f - s, 4) AS dif, round(g, 4) AS dea, round((f - s - g) * 2, 4) AS hist FROM (SELECT code, m.f AS f, m.s AS s, m.g AS g FROM (
  SELECT code, list_reduce(list(struct_pack(f := close, s := close, g := 0.0, first := false) ORDER BY trade_date), lambda a, x: struct_pack(f := a.f * (1 - 2 / 13.0) + x.f * (2 / 13.0), s := a.s * (1 - 2 / 27.0) + x.s * (2 / 27.0),
    g := a.g * 0.8 + ((a.f * (1 - 2 / 13.0) + x.f * (2 / 13.0)) - (a.s * (1 - 2 / 27.0) + x.s * (2 / 27.0))) * 0.2, first := false)) AS m FROM bars GROUP BY 1))""")
def ewma_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macd(a.bars(spark, sf_dir)).select("code", r("dif", 4), r("dea", 4), r("hist", 4))


@add("weekday_calendar", with_ctes("bars") + "SELECT DISTINCT trade_date, CAST(trade_date - CASE isodow(trade_date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS DATE) AS previous_weekday, isodow(trade_date) <= 5 AS is_weekday FROM bars")
def weekday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.bars(spark, sf_dir).select("trade_date").distinct()
    back = F.when(F.weekday("trade_date") == 0, 3).when(F.weekday("trade_date") == 6, 2).otherwise(1)
    return d.select("trade_date", F.date_sub("trade_date", back).alias("previous_weekday"), (F.weekday("trade_date") < 5).alias("is_weekday"))
