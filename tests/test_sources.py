"""The dated source reads what the files hold, only the folders that a filter passes, and long files in pieces; streaks of a stream are those of the table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barlattice.operators import windows
from barlattice.sources import dated
from barlattice.streaming import streaks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dated")
    for k in range(6):
        day = root / f"trade_date=2024-01-0{k + 1}"
        day.mkdir()
        (day / "a.txt").write_text("".join(f"s{k}~{j:06d}~{j}.5~1~2\n" for j in range(40)) + "short", encoding="utf-8")
        (day / "_SUCCESS").write_text("")
    (root / "other=1").mkdir()
    return f"file://{root}"


def read(spark, folder, **more):
    dated.register(spark)
    return spark.read.format("dated").option("path", folder).option("by", "trade_date").options(**more).load()


@pytest.mark.parametrize("split", [1 << 20, 64, 7])
def test_pieces_of_files_hold_every_line_once(spark, folder, split):
    df = read(spark, folder, split=str(split))
    got = sorted(map(tuple, df.where("trade_date <= '2024-01-02'").collect()))
    assert got == sorted((x, f"2024-01-0{k + 1}") for k in range(2) for x in [*(f"s{k}~{j:06d}~{j}.5~1~2" for j in range(40)), "short"])


def test_dates_are_pushed_and_other_filters_are_not(spark, folder):
    df = read(spark, folder).where("trade_date > '2024-01-02' AND trade_date IN ('2024-01-01', '2024-01-03', '2024-01-05') AND value LIKE 's%'")
    assert df.groupBy("trade_date").count().orderBy("trade_date").collect() == [("2024-01-03", 41), ("2024-01-05", 41)]
    jvm = spark.sparkContext._jvm
    plan = df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in plan.splitlines() if line.startswith("Condition")]
    assert all("2024" not in line for line in filters), plan  # the comparisons with days are the source's
    reader = dated.DatedReader({"path": folder, "by": "trade_date"}, df.schema)
    rest = list(reader.pushFilters([dated.GreaterThan(("trade_date",), "2024-01-04"), dated.EqualTo(("value",), "x")]))
    assert [type(f) for f in rest] == [dated.EqualTo] and {p.day for p in reader.partitions()} == {"2024-01-05", "2024-01-06"}
    assert read(spark, folder).where("trade_date = '1999-01-01'").count() == 0


def test_snapshots(spark, tmp_path):
    rows = [("a", 1.5, "d1"), ("b", None, "d1"), ("c", 2.0, "d2")]
    spark.createDataFrame(rows, "code string, price double, trade_date string").write.partitionBy("trade_date").parquet(f"{tmp_path}/s")
    df = read(spark, f"{tmp_path}/s", kind="parquet", fields="code string, price double")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    assert [tuple(r) for r in df.where("trade_date = 'd2'").collect()] == [rows[2]]


def test_streaks_across_batches_are_those_of_the_table(spark, tmp_path):
    """Rows in three batches, some late within the watermark; a last batch far ahead makes the rest certain."""
    rnd = random.Random(6)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(c, day(k), rnd.choice([-1.0, 1.0, 2.0, 0.0])) for c in "abc" for k in range(30) if rnd.random() < 0.9]
    batches = [[], [], []]
    for r in rows:
        b = (r[1] - day(0)).days // 10
        batches[b + 1 if b < 2 and (r[1] - day(0)).days % 10 == 9 and rnd.random() < 0.7 else b].append(r)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaks.PROVIDER)
    (tmp_path / "in").mkdir()
    try:
        stream = spark.readStream.schema("code string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for k, batch in enumerate([*batches, [("end", day(400), 1.0)], [("end", day(401), 1.0)]]):
            spark.createDataFrame(batch, "code string, trade_date date, value double").select("code", F.col("trade_date").cast("timestamp").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = streaks.streaks(stream).writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{tmp_path}/out")
            query.awaitTermination()
            if k == 1:  # nothing is said before it is certain
                assert spark.read.parquet(f"{tmp_path}/out").agg(F.max("ts")).first()[0].date() <= day(20)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r["code"], r["ts"].date(), r["value"], r["streak"]) for r in spark.read.parquet(f"{tmp_path}/out").where("code <> 'end'").collect())
    whole = windows.streak(spark.createDataFrame(rows, "code string, trade_date date, value double"), F.col("value") > 0, "streak")
    assert got == sorted((r["code"], r["trade_date"], r["value"], r["streak"]) for r in whole.collect())
