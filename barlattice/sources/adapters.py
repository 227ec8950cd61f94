"""The market model over the star-schema tables.

Daily bars come from lineitem: the code is the supplier, the day the ship date, the price extendedprice / quantity.
All other tables follow from bars and supplier. Each builder reads only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The day that snapshot queries look at.
AS_OF = "2001-01-31"
#: Limits on this data's daily changes, which are far wider than a stock's.
UP_LIMIT, DOWN_LIMIT = 300.0, -80.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_text(key: Column) -> Column:
    return F.lpad(key.cast("string"), 6, "0")


def code_number(key: Column) -> Column:
    """A number for each code_text, which gives that text again: keys of more than six characters share that of their first six."""
    return F.when(key.between(-99_999, 999_999), key).otherwise(F.substring(key.cast("string"), 1, 6).cast("long"))


def items(spark: SparkSession, sf_dir: str, code: Callable[[Column], Column] = code_text) -> DataFrame:
    """Line items by code and day, dealt by code: days are summed up and all windows by code run where they are, without another shuffle."""
    day = F.col("l_shipdate").cast("date").alias("trade_date")
    rows = table(spark, sf_dir, "lineitem").select(code(F.col("l_suppkey")).alias("code"), day, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    return rows.repartition("code")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, trade_date, open, high, low, close, volume, amount; one row per code and day."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return items(spark, sf_dir).groupBy("code", "trade_date").agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount")
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, trade_date, main_net: amounts of the day, those returned counted as outflow."""
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return items(spark, sf_dir).groupBy("code", "trade_date").agg(F.round(F.sum(signed), 2).alias("main_net"))


def bars_and_flows(spark: SparkSession, sf_dir: str, code: Callable[[Column], Column] = code_text) -> DataFrame:
    """Bars with main_net, from one pass and one shuffle. With code_number codes are numbers, which are dealt and put in order sooner."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return items(spark, sf_dir, code).groupBy("code", "trade_date").agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.round(F.sum(signed), 2).alias("main_net")
    )


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, board, region, profit, circ_mv_yi, debt_ratio: one row per supplier."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        code_text(F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("board"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("profit"),
        (20 + (F.col("s_suppkey") * 37) % 600).cast("double").alias("circ_mv_yi"), ((F.col("s_suppkey") * 13) % 100).cast("double").alias("debt_ratio"),
    )


def by_code() -> Window:
    return Window.partitionBy("code").orderBy("trade_date")


def changes(b: DataFrame) -> DataFrame:
    """Bars with rn, prev_close, pct_change."""
    w = by_code()
    return b.withColumn("rn", F.row_number().over(w)).withColumn("prev_close", F.lag("close").over(w)).withColumn("pct_change", F.try_divide(F.col("close"), F.col("prev_close")) * 100 - 100)


def spot(spark: SparkSession, sf_dir: str, day: str = AS_OF) -> DataFrame:
    """The last bar of each code up to the day, with the change from the bar before, and the stock's attributes."""
    dated = bars(spark, sf_dir).where(F.col("trade_date") <= F.lit(day).cast("date"))
    last = changes(dated).withColumn("back", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))).where("back = 1").drop("back")
    return last.join(stocks(spark, sf_dir), "code").withColumn("turnover_rate", F.col("volume") / 10)


#: The same tables for DuckDB.
BARS_SQL = """bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS px, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY 1, 2)"""
FLOWS_SQL = """flows AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS main_net
  FROM lineitem GROUP BY 1, 2)"""
STOCKS_SQL = """stocks AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, n_name AS board, r_name AS region, s_acctbal AS profit,
         CAST(20 + (s_suppkey * 37) % 600 AS DOUBLE) AS circ_mv_yi, CAST((s_suppkey * 13) % 100 AS DOUBLE) AS debt_ratio
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CHANGES_SQL = """ch AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS prev_close, close / lag(close) OVER w * 100 - 100 AS pct_change FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date))"""
SPOT_SQL = f"""spot AS (
  SELECT s.*, t.name, t.board, t.region, t.profit, t.circ_mv_yi, t.debt_ratio, s.volume / 10 AS turnover_rate
  FROM (SELECT * FROM ch WHERE trade_date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1) s JOIN stocks t USING (code))"""
