"""The recommendation journal as stored tables: recorded by day, evaluated when horizons mature, summed up.

`journal` has a row per run_date and code, `metrics` a row per run_date, code and horizon; both are partitioned by
run_date and versioned, so recording a day rewrites that day only, and an evaluation only the days with a horizon newly complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import ratio
from barlattice.sources.versions import VersionedTable

HORIZONS = (1, 3, 5, 10)


def tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    return VersionedTable(spark, f"{path}/journal", ("run_date", "code"), "run_date"), VersionedTable(spark, f"{path}/metrics", ("run_date", "code", "horizon"), "run_date")


def record(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Upsert candidates (run_date, code, recommended, close and more); returns the journal. Codes are padded to six digits, others than digits are left out; of equal keys any one row stays."""
    fresh = rows.withColumn("code", F.lpad(F.trim("code"), 6, "0")).where(F.col("code").rlike("^[0-9]+$")).dropDuplicates(["run_date", "code"])
    journal = tables(spark, path)[0]
    journal.upsert(fresh)
    found = journal.read()
    return fresh.limit(0) if found is None else found


def after(marks: DataFrame, bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """marks (code, run_date and more) with h<n> for each horizon: date, close, highest high and lowest low of the n bars after run_date; null where there are fewer. One sort by code; marks meet no bars by pairs."""
    w = Window.partitionBy("code").orderBy("trade_date")
    ahead = lambda n: w.rowsBetween(0, n - 1)
    whole = {f"h{n}": F.when(F.count(F.lit(1)).over(ahead(n)) == n, F.struct(F.lead("trade_date", n - 1).over(w).alias("eval_date"), F.lead("close", n - 1).over(w).alias("close"), F.max("high").over(ahead(n)).alias("high"), F.min("low").over(ahead(n)).alias("low"))) for n in horizons}
    row = marks.select(F.struct(*marks.columns).alias("m")).schema["m"].dataType
    coming = bars.join(marks.select("code").distinct(), "code", "left_semi").withColumns(whole)
    steps = coming.select("code", F.col("trade_date").alias("_at"), F.lit(0).alias("_mark"), F.struct(*whole).alias("_next"), F.lit(None).cast(row).alias("_row"))
    asked = marks.select("code", F.to_date("run_date").alias("_at"), F.lit(1).alias("_mark"), F.lit(None).cast(steps.schema["_next"].dataType).alias("_next"), F.struct(*marks.columns).alias("_row"))
    # backwards in time the last bar seen is the first one after; bars of run_date itself come behind its marks
    back = Window.partitionBy("code").orderBy(F.desc("_at"), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    seen = steps.unionByName(asked).withColumn("_first", F.last("_next", ignorenulls=True).over(back)).where("_mark = 1")
    return seen.select("_row.*", "_first.*")


def measured(marks: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """run_date, code, horizon, eval_date, close_return, high_return, low_return, max_drawdown, win for each complete horizon. marks: run_date, code, close (the price recorded)."""
    rows = after(marks.where("close > 0").select("run_date", "code", F.col("close").alias("base")), bars, horizons)
    every = F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"h{n}").alias("h")) for n in horizons])
    long = rows.select("run_date", "code", "base", F.explode(every).alias("x")).where("x.h IS NOT NULL")
    gain = lambda c: ratio(F.col(f"x.h.{c}"), F.col("base")) - 1
    return long.select("run_date", "code", "x.horizon", "x.h.eval_date", gain("close").alias("close_return"), gain("high").alias("high_return"), gain("low").alias("low_return"), F.least(F.lit(0.0), gain("low")).alias("max_drawdown"), F.when(gain("close") > 0, 1).otherwise(0).alias("win"))


def evaluate(spark: SparkSession, path: str, bars: DataFrame, as_of: str, only_recommended: bool = False) -> DataFrame | None:
    """Measure the horizons that are complete by as_of and not measured yet; returns the metrics (None without a journal). bars: code, trade_date, close, high, low."""
    journal, metrics = tables(spark, path)
    rows = journal.read()
    if rows is None:
        return None
    due = rows.where(F.to_date("run_date") < F.lit(as_of).cast("date"))
    due = due.where("recommended") if only_recommended else due
    known = metrics.read()
    if known is not None:
        done = known.groupBy("run_date", "code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(HORIZONS))
        due = due.join(done, ["run_date", "code"], "left_anti")
    fresh = measured(due.select("run_date", "code", "close"), bars.where(F.col("trade_date") <= F.lit(as_of).cast("date")))
    if known is not None:
        fresh = fresh.join(known, ["run_date", "code", "horizon"], "left_anti")
    metrics.upsert(fresh)
    return metrics.read()


def summary(spark: SparkSession, path: str, as_of: str, days: int = 30, only_recommended: bool = False) -> DataFrame:
    """horizon, total, recommended, evaluated, win_rate, avg_return, avg_max_drawdown of the journal's last days."""
    journal, metrics = tables(spark, path)
    rows = journal.read().where((F.to_date("run_date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    rows = rows.where("recommended") if only_recommended else rows
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("recommended").alias("recommended"))
    m = metrics.read()
    if m is None:
        return counts.select(F.lit(None).cast("int").alias("horizon"), "total", "recommended", F.lit(0).cast("long").alias("evaluated"))
    per = m.join(rows.select("run_date", "code"), ["run_date", "code"]).groupBy("horizon").agg(F.count(F.lit(1)).alias("evaluated"), F.avg("win").alias("win_rate"), F.avg("close_return").alias("avg_return"), F.avg("max_drawdown").alias("avg_max_drawdown"))
    return per.crossJoin(F.broadcast(counts))
