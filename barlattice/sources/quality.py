"""Quality of a source, provider chains, dated snapshots and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import number


def assess(df: DataFrame, fields: list[str], day_col: str | None = None, day: str | None = None, most_missing: float = 0.3) -> DataFrame:
    """One row: row_count, n_<field>, missing_<field>, date_match, status (failed without rows, degraded with too many nulls or another day)."""
    share = {f: F.avg(F.when(F.col(f).isNull(), 1.0).otherwise(0.0)) for f in fields}
    match = F.max(F.col(day_col).cast("date") == F.lit(day).cast("date")) if day_col else F.lit(True)
    q = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(f).alias(f"n_{f}") for f in fields], *[c.alias(f"missing_{f}") for f, c in share.items()], match.alias("date_match"))
    bad = ~F.coalesce(F.col("date_match"), F.lit(False))
    for f in fields:
        bad = bad | (F.col(f"missing_{f}") > most_missing)
    return q.withColumn("status", F.when(F.col("row_count") == 0, "failed").when(bad, "degraded").otherwise("ok"))


def first_available(providers: Iterable[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame | None, list[dict]]:
    """The first provider's frame that has rows, and what became of each before it; a provider that raises has failed."""
    chain: list[dict] = []
    for name, read in providers:
        try:
            df = read()
            empty = df.isEmpty()
        except Exception as error:  # noqa: BLE001  a provider may fail in any way; the chain records it and goes on
            chain.append({"provider": name, "status": "failed", "reason": str(error)[:200]})
            continue
        chain.append({"provider": name, "status": "empty" if empty else "ok", "reason": ""})
        if not empty:
            return df, chain
    return None, chain


def by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first frame that has the keys; frames in order of priority."""
    tagged = [p.withColumn("_rank", F.lit(k)) for k, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    return union.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")


def read_snapshot(spark: SparkSession, root: str, name: str, day: str, mode: str = "live") -> DataFrame:
    """Rows of a table partitioned by trade_date: of that day (snapshot), or of the newest day up to it (live, diagnostic)."""
    df = spark.read.parquet(f"{root}/{name}").where(F.col("trade_date") <= F.lit(day).cast("date"))
    if mode == "snapshot":
        return df.where(F.col("trade_date") == F.lit(day).cast("date"))
    newest = df.agg(F.max("trade_date")).first()[0]
    return df.where(F.col("trade_date") == F.lit(newest)).withColumn("stale", F.col("trade_date") < F.lit(day).cast("date"))


def write_snapshot(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Each table's days replaced; one table that fails leaves the others be. Returns the states by name."""
    states = {}
    for name, df in tables.items():
        try:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(f"{root}/{name}")
            states[name] = "ok"
        except Exception as error:  # noqa: BLE001  failures stay with their table
            states[name] = f"failed: {str(error)[:200]}"
    return states


def parse_quote_lines(lines: DataFrame, separator: str = "~", fields: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Delimited quote lines (name, code, price, volume in lots of 100, amount in 1e4) to typed rows, with the columns to keep; short lines go."""
    parts = F.split("value", separator)
    d = lines.withColumn("p", parts).where(F.size("p") >= fields)
    num = lambda k: F.get("p", F.lit(k)).try_cast("double")
    return d.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("code"), num(2).alias("price"), (num(3) * 100).alias("volume"), (num(4) * 1e4).alias("amount"), *(keep or []))


def turnover_fields(df: DataFrame, column: str | None, source: str = "") -> DataFrame:
    """Adds turnover_rate, turnover_missing, turnover_source, turnover_status: a missing turnover is said to be missing, not 0. column: where it is (`scalars.resolve`), None for nowhere."""
    value = number(F.col(f"`{column}`").cast("string")) if column else F.lit(None).cast("double")
    out = df.withColumn("turnover_rate", value)
    missing = F.col("turnover_rate").isNull()
    return out.withColumns({"turnover_missing": missing, "turnover_source": F.lit((source or column) if column else "missing"), "turnover_status": F.when(missing, "missing").otherwise("ok")})
