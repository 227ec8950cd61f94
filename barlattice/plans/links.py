"""Queries of links between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.operators import links
from barlattice.operators import windows as w
from barlattice.plans.common import Catalogue, r, with_ctes
from barlattice.plans.market import POOL, pool
from barlattice.scratch import scratch_path, stored
from barlattice.sources import adapters as a
from barlattice.sources.dated import register
from barlattice.sources.quality import by_priority, parse_quote_lines
from barlattice.streaming import streaks
from barlattice.streaming.rollup import sessions

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("board_last_wins", "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, arg_max(p_brand, (l_orderkey, p_brand)) AS board FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def board_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "part")
    members = items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.col("p_brand").alias("board"), F.col("l_orderkey").alias("place"))
    return links.last_board(members)


@add("fuzzy_board_match", with_ctes("stocks") + "SELECT code, board, matched FROM (SELECT s.code, s.board, b.board AS matched, row_number() OVER (PARTITION BY s.code ORDER BY s.board <> b.board, b.board) AS n FROM stocks s JOIN (SELECT DISTINCT board FROM stocks WHERE CAST(regexp_extract(board, '(\\d+)', 1) AS INTEGER) < 5) b ON contains(s.board, b.board) OR contains(b.board, s.board)) WHERE n = 1")
def fuzzy_board_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = a.stocks(spark, sf_dir)
    return links.fuzzy_boards(s, s.where(F.regexp_extract("board", r"(\d+)", 1).try_cast("int") < 5))


@add("fuzzy_board_match_full", with_ctes("stocks") + "SELECT code, label AS board, matched FROM (SELECT l.code, l.label, b.board AS matched, row_number() OVER (PARTITION BY l.code ORDER BY l.label <> b.board, b.board) AS n FROM (SELECT code, CASE CAST(code AS INTEGER) % 3 WHEN 0 THEN board WHEN 1 THEN region || ' ' || board ELSE region END AS label FROM stocks) l LEFT JOIN (SELECT DISTINCT board FROM stocks) b ON contains(l.label, b.board) OR contains(b.board, l.label)) WHERE n = 1")
def fuzzy_board_match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boards, for stocks whose own label is a board's name, one with the region before it, or the region alone."""
    s, kind = a.stocks(spark, sf_dir), F.col("code").cast("int") % 3
    label = F.when(kind == 0, F.col("board")).when(kind == 1, F.concat_ws(" ", "region", "board")).otherwise(F.col("region"))
    return links.fuzzy_boards(s.select("code", label.alias("board")), s, unmatched=True)


#: Stocks to be looked for: every part by its name, and every long word of the benchmark's items as a stock of that name.
NAMES_SQL = "SELECT 'part ' || p_partkey AS code, p_name AS name FROM part UNION ALL SELECT DISTINCT word, NULL FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM benchmark)"


@add("news_candidate_links", f"WITH c AS ({NAMES_SQL}) SELECT DISTINCT doc_id, code FROM documents, c WHERE contains(text, code) OR contains(text, name)")
def news_candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = a.table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"))
    words = a.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("code")).distinct()
    return links.news_links(a.table(spark, sf_dir, "documents"), parts.unionByName(words, allowMissingColumns=True))


@add("priority_merge", "SELECT key, source FROM (SELECT c_custkey AS key, 'final' AS source, 0 AS k FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'watch', 1 FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'rejected', 2 FROM customer) QUALIFY row_number() OVER (PARTITION BY key ORDER BY k) = 1")
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "customer")
    part = lambda d, s: d.select(F.col("c_custkey").alias("key"), F.lit(s).alias("source"))
    return by_priority([part(c.where("c_acctbal > 5000"), "final"), part(c.where("c_acctbal > 0"), "watch"), part(c, "rejected")], ["key"])


@add("short_line_summary", with_ctes("ch", more=POOL) + "SELECT trade_date, max(streak) AS highest, count(*) FILTER (streak >= 2) AS ladder, count(*) FILTER (abs(open / close - 1) <= 0.001 AND low >= close * 0.999) AS one_price, array_to_string(list_slice(list(code ORDER BY -streak, code), 1, 8), ',') AS leaders FROM pool WHERE is_up GROUP BY 1")
def short_line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.short_line(pool(spark, sf_dir)).withColumn("leaders", F.array_join("leaders", ",")).withColumn("highest", F.col("highest").cast("long"))


@add("technical_snapshot", with_ctes("feat") + "SELECT code, trade_date, round(ma5, 6) AS ma5, round(ma10, 6) AS ma10, round(ma30, 6) AS ma30, round(ma60, 6) AS ma60, round(volume_ratio_prev, 6) AS volume_ratio, least(rn, 60) AS n_bars FROM feat WHERE rn >= 35 QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1")
def technical_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = links.technical_snapshot(w.features(a.bars(spark, sf_dir)))
    return t.select("code", "trade_date", r("ma5"), r("ma10"), r("ma30"), r("ma60"), r("volume_ratio_prev", alias="volume_ratio"), F.size("last60").cast("long").alias("n_bars"))


@add("part_industry", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'jewels' WHEN contains(p_name, 'widget') OR contains(p_name, 'gear') THEN 'machines' ELSE 'other' END AS industry, substr(trim(split_part(p_type, '+', 1)), 1, 18) AS theme FROM part")
def part_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "part")
    return p.select("p_partkey", links.industry(F.col("p_name"), [("jewels", ["ring"]), ("machines", ["widget", "gear"])]).alias("industry"), links.theme(F.col("p_type")).alias("theme"))


@add("user_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(a.table(spark, sf_dir, "events"), "2 hours")


@add("stock_text_scores", "SELECT lang AS code, round(avg(n_chars), 4) AS score FROM documents WHERE lang <> 'de' GROUP BY 1 UNION ALL SELECT 'de', round(avg(n_chars), 4) FROM documents WHERE lang = 'de'")
def stock_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.avg("n_chars").alias("score"))
    return links.fused_score(d.where("code <> 'de'"), d).withColumn("score", r("score", 4))


@add("quote_files", with_ctes("bars") + "SELECT 'n' || code AS name, code, round(close, 6) AS price, volume * 100 AS volume, round(amount * 10000, 2) AS amount, strftime(trade_date, '%Y-%m') AS month FROM bars WHERE strftime(trade_date, '%Y-%m') BETWEEN '2000-08' AND '2001-01'")
def quote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year of quotes from files of quote lines in folders by month; the months are pushed to the source, which opens no other folder."""
    path, day = scratch_path(spark, "quotes"), F.col("trade_date")
    line = F.concat_ws("~", F.concat(F.lit("n"), "code"), "code", F.col("close").cast("string"), F.col("volume").cast("string"), F.col("amount").cast("string"))
    a.bars(spark, sf_dir).select(F.date_format(day, "yyyy-MM").alias("month"), line.alias("value")).repartition("month").write.partitionBy("month").text(path)
    register(spark)
    lines = spark.read.format("dated").option("path", path).option("by", "month").load().where(F.col("month").between("2000-08", "2001-01"))
    return parse_quote_lines(lines, keep=["month"]).select("name", "code", r("price"), "volume", r("amount", 2), "month")


@add("inflow_streak_streamed", with_ctes("flows") + """SELECT code, trade_date, main_net, CASE WHEN main_net > 0 THEN count(*) FILTER (main_net > 0) OVER (PARTITION BY code, island ORDER BY trade_date) ELSE 0 END AS inflow_days
FROM (SELECT *, sum(CASE WHEN main_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY trade_date) AS island FROM flows)""")
def inflow_streak_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as a stream that stops and goes on twice, then says what is left: each row's streak once the watermark has passed it."""
    path, flows = scratch_path(spark, "stream"), stored(a.flows(spark, sf_dir).select("code", F.col("trade_date").cast("timestamp").alias("ts"), F.col("main_net").alias("value")), "flows")
    late = flows.agg(F.max("ts")).first()[0]
    end = lambda days: flows.limit(0).select(F.lit("end").alias("code"), "ts", "value").union(spark.range(1).select(F.lit("end"), F.expr(f"timestamp '{late}' + interval {days} day"), F.lit(0.0)))
    slices = [flows.where("ts < '1997-01-01'"), flows.where("ts >= '1997-01-01' AND ts < '2000-01-01'"), flows.where("ts >= '2000-01-01'"), end(40), end(80)]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streaks.PROVIDER)
    try:
        for rows in slices:
            rows.write.mode("append").parquet(f"{path}/in")
            told = streaks.streaks(spark.readStream.schema(flows.schema).parquet(f"{path}/in"))
            told.writeStream.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(streaks.OUT).parquet(f"{path}/out").where("code <> 'end'")
    return out.select("code", F.col("ts").cast("date").alias("trade_date"), F.col("value").alias("main_net"), F.col("streak").alias("inflow_days"))
