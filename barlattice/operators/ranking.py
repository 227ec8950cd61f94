"""Places, running totals and ranks over all rows of a table, without a task that sees all of them.

Rows are dealt to ranges of the order by sampled bounds and sorted there; each range is counted, and the counts of the
ranges before it are added. What reaches the driver is one number per range. A tie-breaker of the rows' own positions
ends the order, so that long runs of equal keys are dealt to several ranges too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.scratch import stored

#: monotonically_increasing_id() is the partition times this, plus the row's number in it.
ROWS = 33


def dealt(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """df with _at: the range and the place in the range of every row, in this order; written once, so it stays the same for every reader."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df, "unordered").withColumn("_tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(n, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    return stored(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ordered")


def offsets(at: DataFrame, value: Column) -> DataFrame:
    """_range, _before: the sum of value over the ranges before each; a row per range, and so of a known size."""
    sums = sorted((r["_range"], r["v"] or 0) for r in at.groupBy(F.shiftright("_at", ROWS).alias("_range")).agg(F.sum(value).alias("v")).collect())
    rows, before = [], 0
    for k, v in sums:
        rows.append((k, before))
        before += v
    return at.sparkSession.createDataFrame(rows, "_range long, _before long")


def numbered(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """Every row with its place, 1, 2, 3 and so on, in this order; rows that are equal in it get places in any order, each its own."""
    at = dealt(df, order, ranges)
    own = at.withColumn("_range", F.shiftright("_at", ROWS)).join(F.broadcast(offsets(at, F.lit(1))), "_range")
    return own.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROWS) - 1)) + 1).drop("_range", "_at", "_before")


def running_total(df: DataFrame, order: list[Column], value: str, name: str = "before", ranges: int | None = None) -> DataFrame:
    """Every row with the sum of an integer column over the rows before it in this order."""
    at = dealt(df, order, ranges)
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = at.withColumn("_range", F.shiftright("_at", ROWS)).join(F.broadcast(offsets(at, F.coalesce(F.col(value), F.lit(0)))), "_range")
    return own.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_at", "_before")


def ranked(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Every row with the rank of its key in rising order (equal keys share the lowest place), ties (the rows of its key) and of (all rows with a key); null for null keys.

    Keys are counted first, with partial counts before the shuffle, so that only distinct keys are put in order."""
    counts = stored(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("ties")), "keys")
    total = counts.agg(F.sum("ties")).first()[0] or 0
    places = running_total(counts, [F.col("_key").asc()], "ties", "_below", ranges).select("_key", (F.col("_below") + 1).alias("rank"), "ties", F.lit(total).cast("long").alias("of"))
    return df.join(places, F.col(key) == F.col("_key"), "left").drop("_key")


def percentile(rank: Column, ties: Column, of: Column) -> Column:
    """Average rank of a key's ties over the number of rows, 0 to 100."""
    return (rank + (ties - 1) / 2) / of * 100
