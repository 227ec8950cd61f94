"""Per-stock time series: every function is one window pass over long bars, partitioned by code in trading order.

Frames count rows. Averages over n rows are null with fewer than n. All functions of a code share one partitioning and
one order, so a plan that uses many of them shuffles and sorts once.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import average_rank_in, ratio
from barlattice.sources.adapters import by_code


def rows(a: int, b: int):
    return by_code().rowsBetween(a, b)


def running(*columns: str) -> dict[str, Column]:
    """For full_mean, counted and forward of columns of doubles: values up to each row (n_<x>), and the column without nulls (<x>_or_0)."""
    return {f"n_{x}": F.count(x).over(rows(Window.unboundedPreceding, 0)) for x in columns} | {f"{x}_or_0": F.coalesce(x, F.lit(0.0)) for x in columns}


def counted(x: str, a: int, b: int) -> Column:
    """Values of x in the rows a to b, from running counts: a frame costs a step per row in it, these two look-ups. b is not past the last row."""
    up_to = lambda k: F.col(f"n_{x}") if k == 0 else F.lag(f"n_{x}", -k).over(by_code())
    return F.coalesce(up_to(b), F.lit(0)) - F.coalesce(up_to(a - 1), F.lit(0))


def full_mean(x: str | Column, n: int, end: int = 0, ran: bool = False) -> Column:
    """Mean of the n rows up to the row `end`; null if there are fewer. ran: from running sums' columns, with the same additions in the same order."""
    w = rows(end - n + 1, end)
    if ran:
        return F.when(counted(x, end - n + 1, end) == n, F.sum(f"{x}_or_0").over(w) / n)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def row_return(n: int, x: str = "close") -> Column:
    return ratio(F.col(x), F.lag(x, n).over(by_code())) - 1


def true_range() -> Column:
    before = F.lag("close").over(by_code())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def features(b: DataFrame, more: dict[str, Column] | None = None, ran: bool = False) -> DataFrame:
    """Bars with all per-row features; Catalyst prunes those that a query leaves out.

    more: further columns over windows by code, also of rn, that share the pass over them. ran: frames are counted by running counts."""
    w = by_code()
    prev = F.lag("close").over(w)
    mean = partial(full_mean, ran=ran)
    out = b.withColumns({**(running("close", "volume", "amount") if ran else {}), "rn": F.row_number().over(w), "prev_close": prev, "pct_change": ratio(F.col("close"), prev) * 100 - 100, "tr": true_range(), "obv_step": F.coalesce(F.signum(F.col("close") - prev) * F.col("volume"), F.lit(0.0))})
    prior = rows(-20, -1)
    return out.withColumns(
        {
            **{f"ma{n}": mean("close", n) for n in (5, 10, 20, 30, 60)},
            **{f"ret{n}": row_return(n) for n in (3, 5, 10, 19, 20)},
            "prior_high20": F.max("close").over(prior), "prior_low20": F.min("close").over(prior), "prior_n": counted("close", -20, -1) if ran else F.count("close").over(prior),
            "volume_ratio_incl": ratio(F.col("volume"), mean("volume", 5)), "volume_ratio_prev": ratio(F.col("volume"), mean("volume", 5, -1)), "volume_ratio10": ratio(F.col("volume"), mean("volume", 10, -1)), "amount_ratio5": ratio(F.col("amount"), mean("amount", 5, -1)),
            "atr14": F.when(F.col("rn") >= 15, F.avg("tr").over(rows(-13, 0))),
            "obv": F.sum("obv_step").over(rows(Window.unboundedPreceding, 0)), "obv5": F.when(F.col("rn") >= 6, F.sum("obv_step").over(rows(-4, 0))),
            "vol60": F.when(F.count("pct_change").over(rows(-58, 0)) >= 2, F.stddev_samp("pct_change").over(rows(-58, 0)) / 100 * math.sqrt(252) * 100),
            "volume_mean10": mean("volume", 10), "recent_high20": F.max("high").over(rows(-19, 0)), "recent_low20": F.min("low").over(rows(-19, 0)),
            **(more or {}),
        }
    )


FEATURES_SQL = """feat AS (
  SELECT *, CASE WHEN count(pct_change) OVER (c ROWS 58 PRECEDING) >= 2 THEN stddev_samp(pct_change) OVER (c ROWS 58 PRECEDING) / 100 * sqrt(252) * 100 END AS vol60,
    CASE WHEN rn >= 15 THEN avg(tr) OVER (c ROWS 13 PRECEDING) END AS atr14, sum(obv_step) OVER (c ROWS UNBOUNDED PRECEDING) AS obv, CASE WHEN rn >= 6 THEN sum(obv_step) OVER (c ROWS 4 PRECEDING) END AS obv5
  FROM (SELECT *, row_number() OVER c AS rn, lag(close) OVER c AS prev_close, close / lag(close) OVER c * 100 - 100 AS pct_change,
    greatest(high - low, abs(high - lag(close) OVER c), abs(low - lag(close) OVER c)) AS tr, coalesce(sign(close - lag(close) OVER c) * volume, 0.0) AS obv_step,
    """ + ",\n    ".join(
    [f"CASE WHEN count(close) OVER (c ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (c ROWS {n - 1} PRECEDING) END AS ma{n}" for n in (5, 10, 20, 30, 60)]
    + [f"close / lag(close, {n}) OVER c - 1 AS ret{n}" for n in (3, 5, 10, 19, 20)]
    + ["max(close) OVER (c ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high20", "min(close) OVER (c ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_low20", "count(close) OVER (c ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_n"]
    + ["volume / CASE WHEN count(volume) OVER (c ROWS 4 PRECEDING) = 5 THEN avg(volume) OVER (c ROWS 4 PRECEDING) END AS volume_ratio_incl"]
    + [f"{x} / CASE WHEN count({x}) OVER (c ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg({x}) OVER (c ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS {name}" for x, n, name in (("volume", 5, "volume_ratio_prev"), ("volume", 10, "volume_ratio10"), ("amount", 5, "amount_ratio5"))]
    + ["CASE WHEN count(volume) OVER (c ROWS 9 PRECEDING) = 10 THEN avg(volume) OVER (c ROWS 9 PRECEDING) END AS volume_mean10", "max(high) OVER (c ROWS 19 PRECEDING) AS recent_high20", "min(low) OVER (c ROWS 19 PRECEDING) AS recent_low20"]
) + """
    FROM bars WINDOW c AS (PARTITION BY code ORDER BY trade_date)) WINDOW c AS (PARTITION BY code ORDER BY trade_date))"""


def rps(f: DataFrame, value: str = "ret20") -> DataFrame:
    """Relative strength: percentile of the value across each day's market, average ties."""
    return f.where(F.col(value).isNotNull()).withColumn("rps", average_rank_in(F.col(value), Window.partitionBy("trade_date").orderBy(value)))


RPS_SQL = """rps AS (SELECT *, (rank() OVER (PARTITION BY trade_date ORDER BY ret20) + (count(*) OVER (PARTITION BY trade_date, ret20) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) * 100 AS rps FROM feat WHERE ret20 IS NOT NULL)"""


def trend_windows(f: DataFrame, n: int) -> dict[str, Column]:
    """Return over n rows, pullback from the high, rebound from the low, and a state."""
    change = row_return(n) * 100
    pullback = ratio(F.col("close"), F.max("high").over(rows(-n + 1, 0))) * 100 - 100
    rebound = ratio(F.col("close"), F.min("low").over(rows(-n + 1, 0))) * 100 - 100
    state = F.when(change.isNull(), None).when((change > 5) & (pullback > -5), "rising").when(change < -5, "falling").when(rebound > 8, "rebounding").otherwise("sideways")
    return {f"change{n}": change, f"pullback{n}": pullback, f"rebound{n}": rebound, f"state{n}": state}


def streak_of(flag: Column, nth: str) -> Column:
    """Rows in a row, up to and with this one, for which the flag holds: the row's number (nth) less that of the last one without it."""
    off = F.max(F.when(flag, None).otherwise(F.col(nth))).over(rows(Window.unboundedPreceding, 0))
    return F.when(flag, F.col(nth) - F.coalesce(off, F.lit(0))).otherwise(0)


def streak(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """df with its rows' streak_of. One order by code serves all."""
    numbered = df.withColumn("_nth", F.row_number().over(by_code()).cast("long"))
    return numbered.withColumn(name, streak_of(flag, "_nth")).drop("_nth")


def rate_of_change(value: str, order: str, n: int) -> Column:
    past = F.lag(value, n).over(Window.orderBy(order))
    return ratio(F.col(value) - past, F.abs(past)) * 100


def forward(h: int, ran: bool = False) -> dict[str, Column]:
    """What the h rows after this one bring: close return, highest high, lowest low, drawdown, win; null without h rows."""
    w = rows(1, h)
    enough = (counted("close", 1, h) if ran else F.count("close").over(w)) == h
    end = F.lead("close", h).over(by_code())
    low = F.min("low").over(w)
    return {f"fwd_ret{h}": F.when(enough, ratio(end, F.col("close")) - 1), f"fwd_high{h}": F.when(enough, ratio(F.max("high").over(w), F.col("close")) - 1), f"fwd_low{h}": F.when(enough, ratio(low, F.col("close")) - 1), f"fwd_win{h}": F.when(enough, F.when(end > F.col("close"), 1).otherwise(0))}


def equity_metrics(df: DataFrame, value: str = "close") -> DataFrame:
    """By code: total and annualised return, largest drawdown, Sharpe ratio (population deviation)."""
    w = by_code()
    step = df.withColumn("daily", ratio(F.col(value), F.lag(value).over(w)) - 1).withColumn("peak", F.max(value).over(rows(Window.unboundedPreceding, 0)))
    out = step.groupBy("code").agg(F.min_by(value, "trade_date").alias("first"), F.max_by(value, "trade_date").alias("last"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"), F.max(1 - ratio(F.col(value), F.col("peak"))).alias("max_drawdown"), F.avg("daily").alias("mean"), F.stddev_pop("daily").alias("sd"))
    total = ratio(F.col("last"), F.col("first")) - 1
    return out.select("code", total.alias("total_return"), F.when(F.col("days") > 0, F.pow(1 + F.greatest(total, F.lit(-0.9999)), 365.25 / F.col("days")) - 1).alias("annual_return"), "max_drawdown", (ratio(F.col("mean"), F.col("sd")) * math.sqrt(252)).alias("sharpe"))
