"""Calibration from moments that add up: per bin the number of rows, of rises, the mean return and the squares around it.

Rows are first counted by the tuple of all their bins (one integer), so each is aggregated once, not once per feature and horizon. Moments of
a day are merged into those of any span; a store keeps them by day, and a run names the span that it rolled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.functions.scalars import ratio, wilson
from barlattice.operators.evaluation import labels, marked, ranked_marks
from barlattice.sources.versions import VersionedTable

MOMENTS = ("n", "ups", "mean", "m2")
HORIZONS = (5, 10)


def moments(ret: Column) -> Column:
    """A struct of moments of the returns that there are."""
    n = F.count(ret)
    return F.struct(n.alias("n"), F.count_if(ret > 0).alias("ups"), F.avg(ret).alias("mean"), F.when(n > 0, F.var_pop(ret) * n).alias("m2"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Moments of the union of parts, by keys. parts: keys and MOMENTS."""
    n, share = F.sum("n"), F.col("n") * F.col("mean")
    g = parts.groupBy(*keys).agg(n.alias("n"), F.sum("ups").alias("ups"), (F.sum(share) / n).alias("mean"), F.sum("m2").alias("_in"), F.sum(share * F.col("mean")).alias("_sq"))
    # squares around the common mean: inside the parts, and of the parts' means
    return g.withColumn("m2", F.col("_in") + F.greatest(F.lit(0.0), F.col("_sq") - F.col("n") * F.col("mean") * F.col("mean"))).drop("_in", "_sq")


def binned_moments(f: DataFrame, *keys: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """keys, horizon, feature, bin and MOMENTS. f: the features, or marks and rps, and fwd_ret<h>."""
    f = f if "marks" in f.columns else marked(f)
    binned = f.select(*keys, ranked_marks().alias("marks"), *[f"fwd_ret{h}" for h in horizons])
    tuples = binned.groupBy(*keys, "marks").agg(*[moments(F.col(f"fwd_ret{h}")).alias(f"m{h}") for h in horizons])
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("feature"), c.alias("bin"), F.col(f"m{h}").alias("m")) for h in horizons for k, c in labels(F.col("marks")).items()])
    long = tuples.select(*keys, F.explode(each).alias("x")).select(*keys, "x.horizon", "x.feature", "x.bin", "x.m.*").where("bin IS NOT NULL AND n > 0")
    return merged(long, *keys, "horizon", "feature", "bin")


def stats(m: DataFrame) -> DataFrame:
    """Moments with up_share, sd, the Wilson interval and its flags."""
    low, high = wilson(F.col("ups"), F.col("n"))
    g = m.withColumns({"sd": F.sqrt(F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))), "up_share": ratio(F.col("ups").cast("double"), F.col("n")), "ci_low": low, "ci_high": high}).drop("m2")
    return g.withColumn("low_sample", F.col("n") < 30).withColumn("wide_ci", F.col("ci_high") - F.col("ci_low") > 0.30)


def baseline(m: DataFrame) -> DataFrame:
    """stats by horizon, from the bins of a feature that every row has."""
    return stats(merged(m.where("feature = 'ma_bull'"), "horizon"))


def tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    return VersionedTable(spark, f"{path}/moments", ("trade_date", "horizon", "feature", "bin"), "month"), VersionedTable(spark, f"{path}/runs", ("run",), "run")


def extend(spark: SparkSession, path: str, f: DataFrame) -> int:
    """Keep the daily moments of f's days; days that are kept already are replaced. Only their months are written. Returns the version."""
    daily = binned_moments(f, "trade_date").withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    return tables(spark, path)[0].upsert(daily)


def last_day(spark: SparkSession, path: str):
    """The last day with kept moments of the longest horizon: days after it, and those up to the longest horizon before, may still change."""
    kept = tables(spark, path)[0].read()
    return None if kept is None else kept.agg(F.max(F.when(F.col("horizon") == max(HORIZONS), F.col("trade_date")))).first()[0]


def roll(spark: SparkSession, path: str, run: str, as_of: str, days: int = 183) -> DataFrame:
    """stats of the kept days of a span that ends at as_of, recorded as this run with the version that it read."""
    store, runs = tables(spark, path)
    version = store.version()
    months = [m for m in store.manifest(version)["parts"] if m <= as_of[:7]]
    span = (F.col("trade_date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("trade_date") <= F.lit(as_of).cast("date"))
    kept = store.read(version, months).where(span)
    row = kept.agg(F.countDistinct("trade_date").alias("n_days")).select(F.lit(run).alias("run"), F.lit(as_of).alias("as_of"), F.lit(days).alias("days"), F.lit(version).alias("version"), "n_days")
    runs.upsert(row)
    return stats(merged(kept, "horizon", "feature", "bin"))


def load_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The stats of the last run, from the version of the moments that it read; None without a run."""
    store, runs = tables(spark, path)
    manifest = runs.read()
    if manifest is None:
        return None
    last = manifest.orderBy(F.desc("run")).first()
    span = (F.col("trade_date") > F.date_sub(F.lit(last["as_of"]).cast("date"), last["days"])) & (F.col("trade_date") <= F.lit(last["as_of"]).cast("date"))
    return stats(merged(store.read(last["version"]).where(span), "horizon", "feature", "bin")).withColumn("run", F.lit(last["run"]))
