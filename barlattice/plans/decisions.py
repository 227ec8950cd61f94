"""Queries of the decision layer and of the scalars, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.functions import scalars as s
from barlattice.operators import decisions as d
from barlattice.operators import links, news, replies, rules
from barlattice.operators import windows as w
from barlattice.plans.common import Catalogue, layered, r, with_ctes
from barlattice.plans.evaluation import LEX, THEME_SQL, THEMES, lexed
from barlattice.plans.market import DAY, POOL, TEMP, pool, temperature
from barlattice.plans.selection import BASE, DAYS_SQL, GIVEN, POOLED, WIDE_SQL, warm, wide
from barlattice.sources import adapters as a
from barlattice.sources import quality as q

CATALOGUE = Catalogue()
add = CATALOGUE.add
WEEK = "INTERVAL 60 DAY"


@add("code_rules", """SELECT code, CASE substr(code, 1, 2) WHEN '68' THEN 'star' WHEN '30' THEN 'growth' WHEN '60' THEN 'main_sh' ELSE CASE substr(code, 1, 1) WHEN '8' THEN 'north' WHEN '4' THEN 'north' WHEN '0' THEN 'main_sz' ELSE 'other' END END AS venue,
  CASE substr(code, 1, 1) WHEN '6' THEN 'sh' WHEN '9' THEN 'sh' WHEN '8' THEN 'bj' ELSE 'sz' END AS prefix, length(code) = 6 AND substr(code, 1, 3) IN ('600', '601', '603', '605', '688', '000', '001', '002', '003', '300', '301') AS a_share, CASE WHEN substr(code, 1, 2) IN ('30', '68') THEN 19.5 ELSE 9.5 END AS up_limit
FROM (SELECT DISTINCT lpad(CAST(p_partkey * 367 % 1000000 AS VARCHAR), 6, '0') AS code FROM part)""")
def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = a.table(spark, sf_dir, "part").select(s.code6((F.col("p_partkey") * 367 % 1_000_000).cast("string")).alias("code")).distinct()
    c = F.col("code")
    return codes.select("code", s.venue(c).alias("venue"), s.market_prefix(c).alias("prefix"), s.is_a_share(c).alias("a_share"), s.up_limit(c).alias("up_limit"))


@add("text_parsers", """SELECT s_suppkey AS key, CAST(s_acctbal AS DOUBLE) AS pct, round(s_acctbal * CASE s_suppkey % 3 WHEN 0 THEN 1e8 WHEN 1 THEN 1e4 ELSE 1 END, 2) AS amount, CAST(s_suppkey % 9 + 1 AS INTEGER) AS streak, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) END AS num, CASE WHEN s_suppkey % 4 = 0 THEN -1.0 ELSE CAST(s_suppkey AS DOUBLE) END AS safe, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier""")
def text_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k, bal = a.table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_acctbal").cast("decimal(12,2)").cast("string")
    unit = F.when(k % 3 == 0, "亿").when(k % 3 == 1, "万元").otherwise(" 元")
    days = F.when(k % 2 == 0, F.concat(F.lit("12天"), (k % 9 + 1).cast("string"), F.lit("板"))).otherwise(F.concat((k % 9 + 1).cast("string"), F.lit("连板")))
    text = F.when(k % 8 == 0, "n/a").when(k % 4 == 0, "nan").otherwise(k.cast("string"))
    return t.select(k.alias("key"), s.percent_text(F.concat(bal, F.lit("%"))).alias("pct"), F.round(s.amount_text(F.concat(bal, unit)), 2).alias("amount"), s.streak_text(days).alias("streak"), s.number(text).alias("num"), s.safe_number(text, -1.0).alias("safe"), s.code6(k.cast("string")).alias("code"))


@add("mean_interval", with_ctes("spot") + "SELECT board, round(avg(pct_change) - coalesce(1.96 * stddev_samp(pct_change) / sqrt(count(pct_change)), 0), 6) AS mean_low, round(avg(pct_change) + coalesce(1.96 * stddev_samp(pct_change) / sqrt(count(pct_change)), 0), 6) AS mean_high FROM spot GROUP BY 1")
def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    low_high = s.mean_interval("pct_change")
    return a.spot(spark, sf_dir).groupBy("board").agg(*[v.alias(k) for k, v in low_high.items()]).select("board", r("mean_low"), r("mean_high"))


@add("turnover_fields", with_ctes("spot") + "SELECT code, CASE WHEN CAST(code AS INTEGER) % 5 > 0 THEN turnover_rate END AS turnover_rate, CAST(code AS INTEGER) % 5 = 0 AS turnover_missing, 'bars' AS turnover_source, CASE WHEN CAST(code AS INTEGER) % 5 = 0 THEN 'missing' ELSE 'ok' END AS turnover_status FROM spot")
def turnover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = a.spot(spark, sf_dir).select("code", F.when(F.col("code").cast("int") % 5 > 0, F.col("turnover_rate").cast("string")).otherwise("--").alias("turnover (per cent)"))
    return q.turnover_fields(raw, s.resolve(raw.columns, ["rate", "turnover"]), "bars").select("code", "turnover_rate", "turnover_missing", "turnover_source", "turnover_status")


@add("theme_map", with_ctes("ch", "stocks", more=POOL) + f", p AS (SELECT code, board, is_up, pct_change FROM pool JOIN stocks USING (code) WHERE trade_date <= {DAY} AND trade_date > {DAY} - 60) SELECT code, any_value(board) AS theme FROM p WHERE is_up OR pct_change >= 100 GROUP BY 1")
def theme_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(a.AS_OF).cast("date")
    p = pool(spark, sf_dir).where((F.col("trade_date") <= day) & (F.col("trade_date") > F.date_sub(day, 60))).join(a.stocks(spark, sf_dir), "code")
    return d.theme_map(p.where("is_up"), p.where("pct_change >= 100"), links.theme(F.col("board")))


@add("on_demand_candidates", with_ctes("spot", "rps", "flows") + f"""SELECT c.code, round(s.close, 6) AS close, round(x.rps, 6) AS rps, CASE WHEN x.rps IS NULL THEN 'missing' ELSE 'real' END AS rps_mode, coalesce(f.n, 0) AS inflow_days
FROM (SELECT lpad(CAST(n_nationkey * 3 AS VARCHAR), 6, '0') AS code FROM nation UNION SELECT 'none') c LEFT JOIN spot s USING (code) LEFT JOIN (SELECT code, arg_max(rps, trade_date) AS rps FROM rps WHERE trade_date <= {DAY} GROUP BY 1) x USING (code) LEFT JOIN (SELECT code, count(*) AS n FROM flows WHERE trade_date <= {DAY} AND main_net > 0 GROUP BY 1) f USING (code)""")
def on_demand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("trade_date") <= F.lit(a.AS_OF).cast("date")
    asked = a.table(spark, sf_dir, "nation").select(F.lpad((F.col("n_nationkey") * 3).cast("string"), 6, "0").alias("code")).union(spark.createDataFrame([("none",)], "code string"))
    rps = w.rps(w.features(a.bars(spark, sf_dir))).where(day).groupBy("code").agg(F.max_by("rps", "trade_date").alias("rps"))
    inflow = a.flows(spark, sf_dir).where(day & (F.col("main_net") > 0)).groupBy("code").agg(F.count(F.lit(1)).alias("inflow_days"))
    return d.on_demand(asked, a.spot(spark, sf_dir).select("code", "close"), rps, inflow).select("code", r("close"), r("rps"), "rps_mode", "inflow_days")


@add("approximate_rps", with_ctes("spot", "feat") + f"""SELECT f.code, round(CASE WHEN f.ret20 IS NULL THEN 50.0 ELSE (SELECT count(*) FILTER (pct_change < f.ret20) * 100.0 / count(pct_change) FROM spot) END, 6) AS rps FROM (SELECT code, arg_max(ret20, trade_date) FILTER (ret20 IS NOT NULL) AS ret20 FROM feat WHERE trade_date <= {DAY} GROUP BY 1) f""")
def approximate_rps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = w.features(a.bars(spark, sf_dir)).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date"))
    last = f.groupBy("code").agg(F.max_by("ret20", F.when(F.col("ret20").isNotNull(), F.col("trade_date"))).alias("ret20"))
    return d.approximate_rps(last, a.spot(spark, sf_dir)).select("code", r("rps"))


@add("rps_for_codes", with_ctes("rps") + f"SELECT code, round(rps, 6) AS rps, CASE WHEN rps IS NULL THEN 'missing' ELSE 'real' END AS rps_mode FROM (SELECT DISTINCT lpad(CAST(n_nationkey * 7 AS VARCHAR), 6, '0') AS code FROM nation) LEFT JOIN (SELECT code, arg_max(rps, trade_date) AS rps FROM rps WHERE trade_date <= {DAY} GROUP BY 1) USING (code)")
def rps_for_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = a.table(spark, sf_dir, "nation").select(F.lpad((F.col("n_nationkey") * 7).cast("string"), 6, "0").alias("code"))
    table = w.rps(w.features(a.bars(spark, sf_dir))).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date")).groupBy("code").agg(F.max_by("rps", "trade_date").alias("rps"))
    return d.rps_for_codes(asked, table).select("code", r("rps"), "rps_mode")


@add("stock_inspection", with_ctes("spot", "flows") + f"""SELECT code, round(sum(b.close), 4) AS closes, count(b.close) AS n_bars, round(arg_min(b.close, b.trade_date), 6) AS oldest, (SELECT round(sum(main_net), 2) FROM (SELECT main_net FROM flows f WHERE f.code = b.code AND trade_date <= {DAY} ORDER BY trade_date DESC LIMIT 10)) AS nets, round(any_value(spot.pct_change), 6) AS pct_change
FROM (SELECT code, trade_date, close, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars WHERE trade_date <= {DAY}) b JOIN spot USING (code) WHERE k <= 10 AND code IN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') FROM nation) GROUP BY code""")
def stock_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("trade_date") <= F.lit(a.AS_OF).cast("date")
    spot = a.spot(spark, sf_dir)
    asked = a.table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("code")).join(spot.select("code"), "code", "left_semi")
    x = d.inspect(asked, a.bars(spark, sf_dir).where(day), a.flows(spark, sf_dir).where(day), spot)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
    return x.select("code", F.round(total("closes"), 4).alias("closes"), F.size("closes").cast("long").alias("n_bars"), F.round(F.get("closes", F.lit(0)), 6).alias("oldest"), F.round(total("nets"), 2).alias("nets"), r("pct_change"))


INDEX_SQL = with_ctes("bars", more="ix AS (SELECT code, arg_max(close, trade_date) AS close, avg(close) AS ma20 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars) WHERE k <= 20 GROUP BY 1 HAVING count(*) = 20)")


@add("index_deviation", INDEX_SQL + "SELECT code, round(ma20, 6) AS ma20, round((close - ma20) / ma20 * 100, 6) AS deviate_pct FROM ix")
def index_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.index_deviation(a.bars(spark, sf_dir)).select("code", r("ma20"), r("deviate_pct"))


@add("index_deviation_mean", INDEX_SQL + "SELECT round(avg((close - ma20) / ma20 * 100), 6) AS mean_deviation, count(*) AS n FROM ix")
def index_deviation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.index_deviation(a.bars(spark, sf_dir)).agg(F.round(F.avg("deviate_pct"), 6).alias("mean_deviation"), F.count(F.lit(1)).alias("n"))


@add("board_flow_status", with_ctes("flows", "stocks") + ", b AS (SELECT board, round(sum(main_net), 2) AS net FROM flows JOIN stocks USING (code) GROUP BY 1) SELECT (SELECT count(*) FROM b WHERE net > 0) AS inflow_boards, (SELECT count(*) FROM b WHERE net < 0) AS outflow_boards, (SELECT string_agg(board, ',' ORDER BY net DESC, board) FROM (SELECT * FROM b ORDER BY net DESC, board LIMIT 3)) AS top_inflow")
def board_flow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = a.flows(spark, sf_dir).join(a.stocks(spark, sf_dir).select("code", "board"), "code").groupBy("board").agg(F.round(F.sum("main_net"), 2).alias("net"))
    return d.board_flow_status(per)


@add("verdict_order", with_ctes("spot") + "SELECT code, score, verdict, row_number() OVER (ORDER BY score DESC, CASE verdict WHEN 'recommend' THEN 0 WHEN 'watch' THEN 1 ELSE 2 END, code) AS place FROM (SELECT code, round(pct_change, -1) AS score, CASE WHEN pct_change > 50 THEN 'recommend' WHEN turnover_rate > 5 THEN 'watch' ELSE 'avoid' END AS verdict FROM spot)")
def verdict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = a.spot(spark, sf_dir).select("code", F.round("pct_change", -1).alias("score"), F.when(F.col("pct_change") > 50, "recommend").when(F.col("turnover_rate") > 5, "watch").otherwise("avoid").alias("verdict"))
    return d.ordered_verdicts(x, ["recommend", "watch", "avoid"])


@add("pool_layers", DAYS_SQL + f"SELECT pool_layer, code, round(CAST(pool_score AS DOUBLE), 4) AS pool_score, place FROM (SELECT *, row_number() OVER (PARTITION BY pool_layer ORDER BY pool_score DESC, code) AS place FROM {layered('warm_wide', POOLED)}) WHERE place <= CASE pool_layer WHEN 'core' THEN 8 ELSE 60 END")
def pool_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.derive(warm(spark, sf_dir), POOLED).select("code", "pool_layer", "pool_score")
    return d.top_of_groups(x, "pool_layer", "pool_score", {"core": 8, "watch": 60, "rejected": 60}).select("pool_layer", "code", r(F.col("pool_score").cast("double"), 4, "pool_score"), "place")


EVIDENCE_SQL = "WITH " + LEX + f", ev AS (SELECT *, CASE WHEN score > 55 THEN 'bullish' WHEN score < 45 THEN 'bearish' ELSE 'neutral' END AS label FROM (SELECT *, least(greatest(50 + (bull - bear - 1.5 * risk) / greatest(bull + bear + risk, 1) * 50, 0), 100) AS score FROM (SELECT theme, count(*) AS support, count(*) FILTER (kind LIKE 'bullish%') AS bull, count(*) FILTER (kind LIKE 'bearish%') AS bear, count(*) FILTER (risks > 0) AS risk FROM lx, {THEME_SQL} WHERE contains(text, theme) GROUP BY 1)))"


@add("market_narrative", EVIDENCE_SQL + " SELECT row_number() OVER (ORDER BY score DESC, theme) AS place, theme, label, round(score, 1) AS score, CASE label WHEN 'bullish' THEN theme || ' driven by good news (' || bull || ')' WHEN 'bearish' THEN theme || ' under bad news or risk (' || bear || ' / ' || risk || ')' ELSE theme || ' mixed (' || bull || ' / ' || bear || ' / ' || risk || ')' END AS summary FROM ev WHERE support > 0 ORDER BY 1 LIMIT 8")
def market_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.narrative(news.theme_evidence(lexed(spark, sf_dir), THEMES))


@add("news_catalysts", with_ctes("spot") + ", " + EVIDENCE_SQL.removeprefix("WITH ") + " SELECT * FROM (SELECT *, row_number() OVER (ORDER BY kind, support DESC, name) AS place FROM (SELECT 'theme' AS kind, theme AS name, support FROM ev WHERE label = 'bullish' AND support >= 2 UNION ALL SELECT 'candidate', code, CAST(code AS BIGINT) % 7 FROM spot WHERE pct_change > 0 AND CAST(code AS BIGINT) % 7 > 1)) WHERE place <= 15")
def news_catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("code").cast("long") % 7
    held = a.spot(spark, sf_dir).select("code", F.when(F.col("pct_change") > 0, "bullish").otherwise("neutral").alias("label"), (n - 1).alias("direct"), n.alias("support"))
    return d.catalysts(news.theme_evidence(lexed(spark, sf_dir), THEMES), held)


@add("theme_evolution", """WITH c AS (SELECT event_type AS theme, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY day DESC) AS b FROM c QUALIFY b <= 7),
g AS (SELECT theme, max(n) FILTER (b = 1) AS v1, max(n) FILTER (b = 2) AS v2, max(n) FILTER (b = 3) AS v3, arg_max(n, b) AS first, count(*) AS n FROM k GROUP BY 1)
SELECT theme, first, v1 AS last, n, CASE WHEN v1 > v2 AND v2 > v3 THEN 'up' WHEN v1 < v2 AND v2 < v3 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN n >= 2 AND v1 > first THEN 'up' WHEN n >= 2 AND v1 < first THEN 'down' ELSE 'flat' END AS change FROM g""")
def theme_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = a.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("theme"), F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.evolution(daily.withColumnRenamed("n", "v"), "theme", "v")


@add("tracked_themes", "SELECT DISTINCT trim(t) AS theme FROM (SELECT n_name AS t FROM nation UNION ALL SELECT event_type FROM events UNION ALL SELECT lang FROM documents) WHERE trim(t) <> ''")
def tracked_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.tracked_themes(a.table(spark, sf_dir, "nation").select("n_name"), a.table(spark, sf_dir, "events").select("event_type"), a.table(spark, sf_dir, "documents").select("lang"))


@add("news_dedup_prefix", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY substr(coalesce(text, ''), 1, 80) ORDER BY doc_id) = 1")
def news_dedup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.dedup_prefix(a.table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "lang")


@add("latest_by_user", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.latest(a.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "event_type")


@add("calibration_universe", with_ctes("bars") + "SELECT CAST(trade_date AS VARCHAR) AS item, 'day' AS kind FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS k FROM bars WHERE code = '000001') WHERE k > 10 UNION ALL SELECT DISTINCT code, 'code' FROM bars")
def calibration_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, codes = d.calibration_universe(a.bars(spark, sf_dir).select("code", "trade_date"), "000001")
    return days.select(F.col("trade_date").cast("string").alias("item"), F.lit("day").alias("kind")).union(codes.select("code", F.lit("code")))


@add("factor_collection", with_ctes("spot", "flows") + f"""SELECT code, in_budget, round(CASE WHEN in_budget THEN net END, 2) AS flow_net, CASE WHEN in_budget THEN n END AS flow_days, round(up_share, 6) AS up_share FROM (SELECT *, row_number() OVER (ORDER BY pct_change DESC, code) <= 40 AS in_budget, avg(CASE WHEN pct_change > 0 THEN 1.0 ELSE 0.0 END) OVER () AS up_share FROM spot WHERE pct_change IS NOT NULL) LEFT JOIN (SELECT code, sum(main_net) AS net, count(*) AS n FROM flows WHERE trade_date <= {DAY} GROUP BY 1) USING (code)""")
def factor_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = a.spot(spark, sf_dir).where("pct_change IS NOT NULL").select("code", F.col("pct_change").alias("score"))
    flow = a.flows(spark, sf_dir).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date")).groupBy("code").agg(F.sum("main_net").alias("net"), F.count(F.lit(1)).alias("n"))
    x = d.collect_factors(spot, {"breadth": spot.agg(F.avg(F.when(F.col("score") > 0, 1.0).otherwise(0.0)).alias("up_share"))}, {"flow": flow}, budget=40)
    return x.select("code", "in_budget", F.round("flow.net", 2).alias("flow_net"), F.col("flow.n").alias("flow_days"), r("up_share"))


@add("page_facts", """SELECT page_id, p_retailprice AS eps_consensus, CASE WHEN p_size % 3 = 0 THEN '买入' WHEN p_size % 3 = 1 THEN '增持' END AS rating, CAST(p_size AS INTEGER) AS analyst_count, CASE WHEN p_size % 2 = 0 THEN p_size / 4 END AS dividend_per_share, CASE WHEN p_size % 2 = 0 THEN '2024-06-1' || (p_size % 9) END AS ex_date, CASE WHEN p_size % 5 = 0 THEN 3.0 END AS bonus_ratio, CASE WHEN p_size % 5 = 0 THEN p_size / 10 END AS transfer_ratio
FROM pages LEFT JOIN part ON p_partkey = page_id""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored web pages, each with a box on the part of its number in front of its footer, if there is such a part."""
    some = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).otherwise("")
    size, price = F.col("p_size"), F.col("p_retailprice").cast("decimal(12,2)")
    box = F.concat(F.lit("<table><tr><td>一致预期每股收益：</td><td><b>"), price.cast("string"), F.lit("</b></td></tr></table><p>"), some(size % 3 == 0, "综合评级： 买入 </p>"), some(size % 3 == 1, "综合评级:<i>增持</i>"), F.lit("共"), size.cast("string"), F.lit("位分析师"), some(size % 2 == 0, "每股派息&nbsp;", size / 4, " 元 除权除息日：2024-06-1", size % 9), some(size % 5 == 0, " 送股： 每10股送3股 转增：每10股转增", size / 10, "股"))
    pages = a.table(spark, sf_dir, "pages").join(a.table(spark, sf_dir, "part"), F.col("page_id") == F.col("p_partkey"), "left")
    return d.page_facts(pages.select("page_id", F.concat("html", F.coalesce(box, F.lit(""))).alias("html"))).drop("html")


@add("event_properties", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_id % 5 <> 4 AS quoted FROM events")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's properties, after these have come through as replies do: cut before the end, in single quotes, in a fence, with a text around, or whole."""
    e, kind, raw = a.table(spark, sf_dir, "events"), F.col("event_id") % 5, F.col("props")
    text = F.when(kind == 0, F.rtrim(raw, F.lit("}"))).when(kind == 1, F.replace(raw, F.lit('"'), F.lit("'"))).when(kind == 2, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(kind == 3, F.concat(F.lit("as asked {} : "), raw, F.lit(" }} so"))).otherwise(F.replace(raw, F.lit('"'), F.lit("")))
    return e.select("event_id", F.get_json_object(replies.repaired(text), "$.k").cast("long").alias("k"), (kind != 4).alias("quoted"))


@add("factor_notes", WIDE_SQL + f"SELECT code, concat_ws(', ', CASE WHEN lhb_net_wan > 0 THEN 'dragon-tiger net buying' END, CASE WHEN hot_rank <> 0 THEN 'hot list' END, CASE WHEN flow20 > 0 THEN '20-day inflow' END, CASE WHEN north5 > 0 THEN 'northbound buying' END) AS reasons, concat_ws(', ', CASE WHEN flow20 < 0 THEN '20-day outflow' END, CASE WHEN north5 < 0 THEN 'northbound selling' END, CASE WHEN n_ann_risks > 0 THEN 'risk announcement' END) AS risks FROM {layered('wide', [*BASE, GIVEN])}")
def factor_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons, risks = d.factor_notes()
    return rules.derive(wide(spark, sf_dir), [*BASE, GIVEN]).select("code", F.array_join(reasons, ", ").alias("reasons"), F.array_join(risks, ", ").alias("risks"))


@add("executed_exits", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity <= 1100 AS hit_stop, l_extendedprice / l_quantity >= 1500 AS hit_target FROM lineitem WHERE l_returnflag = 'R'")
def executed_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sells = a.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(1100.0).alias("stop"), F.lit(1500.0).alias("target"))
    return d.executed(sells).select("l_orderkey", "l_linenumber", "l_partkey", "hit_stop", "hit_target")


SOURCES = ["all_spot", "daily_kline", "entry_exit", "rps", "fund_flow", "quant_guard", "volume_audit"]
STATES_SQL = f"st AS (SELECT CAST(ts AS DATE) AS run, {SOURCES}[1 + event_id % 7] AS source, CASE WHEN event_id % 7 < 3 AND value > 490 THEN 'failed' WHEN event_id % 7 > 3 AND value > 498 THEN 'degraded' ELSE 'ok' END AS status, event_id, value FROM events)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, source, status of every event: a stand-in for the log of sources. Of one source's states in a run, the last by name counts, which is the worst but for failed before ok."""
    k, v = F.col("event_id") % 7, F.col("value")
    return a.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("run"), F.element_at(F.array(*map(F.lit, SOURCES)), (k + 1).cast("int")).alias("source"), F.when((k < 3) & (v > 490), "failed").when((k > 3) & (v > 498), "degraded").otherwise("ok").alias("status"), "event_id", "value")


@add("quality_verdict", "WITH " + STATES_SQL + """, p AS (SELECT run, max(status) FILTER (source = 'all_spot') AS a, max(status) FILTER (source = 'daily_kline') AS b, max(status) FILTER (source = 'entry_exit') AS c, max(status) FILTER (source = 'rps') AS d, max(status) FILTER (source = 'fund_flow') AS e, max(status) FILTER (source = 'quant_guard') AS f, max(status) FILTER (source = 'volume_audit') AS g,
  avg(CASE WHEN event_id % 3 = 0 AND day(run) % 2 = 0 THEN 1.0 ELSE 0.0 END) AS gap, count(*) FILTER (event_id % 50 = 0) AS finals FROM st GROUP BY 1),
n AS (SELECT *, CAST(coalesce(a = 'failed', false) AS INTEGER) + CAST(coalesce(b = 'failed', false) AS INTEGER) + CAST(coalesce(c = 'failed', false) AS INTEGER) + CAST(gap > 0.3 AS INTEGER) AS n_failed, CAST(coalesce(c IN ('failed', 'degraded'), false) AS INTEGER) + CAST(coalesce(e IN ('failed', 'degraded'), false) AS INTEGER) + CAST(coalesce(f IN ('failed', 'degraded'), false) AS INTEGER) + CAST(coalesce(g IN ('failed', 'degraded'), false) AS INTEGER) + CAST(d IS DISTINCT FROM 'ok' AS INTEGER) AS n_degraded FROM p)
SELECT run, CASE WHEN n_failed > 0 THEN 'failed' WHEN n_degraded > 0 THEN 'degraded' ELSE 'ok' END AS verdict, n_failed = 0 AND n_degraded = 0 AND finals > 0 AS tradable, n_failed, n_degraded FROM n""")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = states(spark, sf_dir)
    gone = (F.col("event_id") % 3 == 0) & (F.day("run") % 2 == 0)
    fields = x.select("run", F.when(~gone, F.col("value")).alias("close"), F.col("value").alias("pct_change"), F.col("value").alias("turnover_rate"), (F.col("event_id") % 50 == 0).alias("is_final"))
    return d.quality_verdict(x, fields)


@add("status_rollup", "WITH " + STATES_SQL + """ SELECT run AS "group", CASE WHEN bool_or(status = 'failed' AND source IN ('all_spot', 'daily_kline')) THEN 'failed' WHEN bool_or(status <> 'ok') THEN 'degraded' ELSE 'ok' END AS status FROM st GROUP BY 1""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.status_rollup(states(spark, sf_dir).select(F.col("run").alias("group"), "source", F.col("source").isin("all_spot", "daily_kline").alias("critical"), "status"))


@add("price_fallback", with_ctes("spot") + """, h AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CAST(s_acctbal AS DOUBLE) AS cost, s_suppkey FROM supplier), t AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey)) AS traded FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1)
SELECT h.code, round(coalesce(q.close, t.traded, h.cost), 6) AS price, CASE WHEN q.close IS NOT NULL THEN 'spot' WHEN t.traded IS NOT NULL THEN 'trade' ELSE 'cost' END AS price_source FROM h LEFT JOIN (SELECT code, close FROM spot WHERE CAST(code AS INTEGER) % 2 = 0) q USING (code) LEFT JOIN t USING (code)""")
def price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.lpad(F.col(c).cast("string"), 6, "0").alias("code")
    held = a.table(spark, sf_dir, "supplier").select(code("s_suppkey"), F.col("s_acctbal").cast("double").alias("cost"))
    traded = a.table(spark, sf_dir, "lineitem").where("l_suppkey % 3 > 0").select(code("l_suppkey"), F.col("l_extendedprice").alias("price"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return links.price_fallback(held, a.spot(spark, sf_dir).where("cast(code AS int) % 2 = 0"), traded).select("code", r("price"), "price_source")


@add("overlay_fields", with_ctes("spot") + "SELECT code, CASE WHEN CAST(code AS INTEGER) % 3 = 0 THEN 'named ' || code ELSE name END AS name, CASE WHEN CAST(code AS INTEGER) % 3 = 1 THEN 1.5 ELSE round(turnover_rate, 6) END AS turnover_rate FROM spot")
def overlay_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = a.spot(spark, sf_dir).select("code", "name", r("turnover_rate"))
    k = F.col("code").cast("int") % 3
    over = base.select("code", F.when(k == 0, F.concat(F.lit("named "), "code")).otherwise("").alias("name"), F.when(k == 1, 1.5).alias("turnover_rate"))
    return links.overlay(base, over, "code", ["name", "turnover_rate"])


@add("event_pool", with_ctes("spot") + """, dr AS (SELECT code, max(CASE WHEN pct_change > 0 THEN 1.0 ELSE -1.0 END) AS net FROM spot WHERE CAST(code AS INTEGER) % 4 = 0 GROUP BY 1), hot AS (SELECT code FROM spot WHERE pct_change >= 5 ORDER BY pct_change DESC, code LIMIT 50), told AS (SELECT code, CASE CAST(code AS INTEGER) % 3 WHEN 0 THEN 40.0 WHEN 1 THEN 72.0 END AS score FROM hot)
SELECT code, max(score) AS score FROM (SELECT code, CASE WHEN net > 0 THEN 75.0 ELSE 70.0 END AS score FROM dr UNION ALL SELECT * FROM told WHERE score IS NOT NULL) GROUP BY 1""")
def event_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = a.spot(spark, sf_dir)
    k = F.col("code").cast("int")
    dragon = spot.where(k % 4 == 0).select("code", F.when(F.col("pct_change") > 0, 1.0).otherwise(-1.0).alias("net"))
    titles = spot.select("code", F.col("trade_date").alias("ts"), F.when(k % 3 == 0, "share sale planned").when(k % 3 == 1, "large contract won").otherwise("notice").alias("title"))
    return rules.event_pool(dragon, spot, titles, "sale", "contract")


@add("candidate_evidence", WIDE_SQL + f""", x AS (SELECT * FROM {layered('wide', [*BASE, *rules.debate(), *rules.gate()])}) SELECT code, bucket AS status, guard_status AS guarded_state, strategy, strategy IS NULL AS is_trend_only, round(rps, 6) AS rps, turnover_rate IS NULL AS turnover_missing FROM x""")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.derive(wide(spark, sf_dir), [*BASE, *rules.debate(), *rules.gate()])
    out = d.evidence_of(x.withColumns({"status": F.col("bucket"), "signal_score": F.col("rps"), "trigger": F.lit("rule"), "guarded": F.col("guard_status")}))
    return out.select("code", "status", "guarded_state", F.col("strategy_evidence.strategy").alias("strategy"), F.col("strategy_evidence.is_trend_only").alias("is_trend_only"), r("price_action.rps", alias="rps"), F.col("liquidity.turnover_missing").alias("turnover_missing"))


@add("point_in_time", with_ctes("ch") + "SELECT d.day, b.code, CAST(b.trade_date AS VARCHAR) AS known, round(b.close, 6) AS close FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-31', DATE '2001-01-31', INTERVAL 6 MONTH)) AS DATE) AS day) d CROSS JOIN (SELECT DISTINCT code FROM bars) c ASOF JOIN bars b ON b.code = c.code AND d.day >= b.trade_date")
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.point_in_time(a.bars(spark, sf_dir), "1996-01-31", "2001-01-31", "INTERVAL 6 MONTH").select("day", "code", F.col("trade_date").cast("string").alias("known"), r("close"))


@add("point_in_time_boards", with_ctes("ch", "stocks") + "SELECT day, board, count(*) AS n, count(*) FILTER (pct_change > 0) AS up, round(avg(pct_change), 6) AS mean_pct, round(sum(amount), 2) AS amount FROM (SELECT d.day, b.* FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-31', DATE '2001-01-31', INTERVAL 6 MONTH)) AS DATE) AS day) d CROSS JOIN (SELECT DISTINCT code FROM bars) c ASOF JOIN ch b ON b.code = c.code AND d.day >= b.trade_date) JOIN stocks USING (code) GROUP BY 1, 2")
def point_in_time_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = d.point_in_time(a.changes(a.bars(spark, sf_dir)), "1996-01-31", "2001-01-31", "INTERVAL 6 MONTH")
    return d.board_view(then, a.stocks(spark, sf_dir), "day").select("day", "board", "n", "up", r("mean_pct"), r("amount", 2))


@add("tag_strength", with_ctes("spot") + ", t AS (SELECT code, board AS tag FROM spot UNION SELECT code, region FROM spot UNION SELECT code, CASE WHEN circ_mv_yi > 300 THEN 'large' ELSE 'small' END FROM spot) SELECT *, row_number() OVER (ORDER BY mean_pct DESC, tag) AS place FROM (SELECT tag, count(*) AS n, count(*) FILTER (pct_change > 0) AS up, round(avg(pct_change), 6) AS mean_pct, round(sum(amount), 2) AS amount FROM spot JOIN t USING (code) GROUP BY 1)")
def tag_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = a.spot(spark, sf_dir)
    tags = spot.select("code", F.array("board", "region", F.when(F.col("circ_mv_yi") > 300, "large").otherwise("small")).alias("tags"))
    return d.tag_strength(spot.select("code", "pct_change", "amount"), tags).select("tag", "n", "up", r("mean_pct"), r("amount", 2), "place")


@add("market_posture", with_ctes("ch", more=TEMP) + "SELECT trade_date, round(temperature, 6) AS temperature, CASE WHEN temperature < 40 THEN 'cold' WHEN temperature > 85 THEN 'hot' ELSE 'normal' END AS posture FROM tp")
def market_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = temperature(spark, sf_dir)
    return t.select("trade_date", r("temperature"), d.posture(F.col("temperature")).alias("posture"))


@add("broke_share", "SELECT CAST(ts AS DATE) AS day, round(sum(broken) * 100.0 / (count(*) + sum(broken)), 6) AS broke_share FROM (SELECT ts, CASE WHEN day(ts) % 3 > 0 THEN event_id % 4 END AS broken FROM events) GROUP BY 1")
def broke_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = a.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_id", F.when(F.day("ts") % 3 > 0, F.col("event_id") % 4).alias("broken"))
    return x.groupBy("day").agg(d.broke_share(F.col("broken"), F.col("event_id")).alias("broke_share")).select("day", r("broke_share"))


@add("theme_names", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE substr('Theme ' || s_suppkey, 1, 18) END AS theme FROM supplier")
def theme_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rest = F.element_at(F.array(*[F.lit(x) for x in ("、b,c", ",b", "/b|c", " + d", "，x", ";y", "；z", "|w", "")]), (k % 9 + 1).cast("int"))
    text = F.when(k % 10 == 9, F.when(k % 20 == 9, "NaN").otherwise(" - ")).otherwise(F.concat(F.lit(" Theme "), k.cast("string"), rest))
    return a.table(spark, sf_dir, "supplier").select(k.alias("key"), links.theme(text).alias("theme"))


@add("finite_values", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    return links.finite(a.table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.col("value")).when(k == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf"))).alias("value")))


@add("reply_verdicts", "SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 3 THEN NULL WHEN 0 THEN 'watch' ELSE 'avoid' END AS verdict, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE CAST(s_suppkey % 100 AS DOUBLE) END AS confidence FROM supplier")
def reply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = (k % 100).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit('well: {"verdict": "watch", "confidence": '), n, F.lit("} so"))).when(k % 4 == 1, F.concat(F.lit("{verdict: 'avoid', confidence: "), n, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit("verdict = avoid; confidence = "), n)).otherwise("no idea")
    return a.table(spark, sf_dir, "supplier").select(k.alias("key"), links.verdict_json(text).alias("v")).select("key", "v.*")


@add("quote_lines", "SELECT s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CAST(s_suppkey AS DOUBLE) / 4 AS price, s_suppkey * 100.0 AS volume, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 20000.0 END AS amount FROM supplier WHERE s_suppkey % 7 > 0")
def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    amount = F.when(k % 5 > 0, (k * 2).cast("string")).otherwise("--")
    line = F.when(k % 7 > 0, F.concat_ws("~", "s_name", F.lpad(k.cast("string"), 6, "0"), (k / 4).cast("string"), k.cast("string"), amount)).otherwise(F.concat_ws("~", "s_name", F.lit("x")))
    return q.parse_quote_lines(a.table(spark, sf_dir, "supplier").select(line.alias("value")))


@add("inherited_evidence", with_ctes("stocks") + ", " + EVIDENCE_SQL.removeprefix("WITH ") + ", th AS (SELECT theme, score, row_number() OVER (ORDER BY theme) - 1 AS k FROM ev), m AS (SELECT count(*) AS n FROM ev), g AS (SELECT code FROM stocks, m JOIN th ON th.k = CAST(stocks.code AS INTEGER) % (2 * m.n) GROUP BY 1) SELECT code, CASE WHEN CAST(code AS INTEGER) % 4 = 0 THEN 'direct' ELSE 'inherited' END AS kind, CASE WHEN CAST(code AS INTEGER) % 4 = 0 THEN CAST(code AS DOUBLE) ELSE 50.0 END AS score FROM stocks WHERE CAST(code AS INTEGER) % 4 = 0 OR code IN (SELECT code FROM g)")
def inherited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = news.theme_evidence(lexed(spark, sf_dir), THEMES).select("theme", "score")
    placed = found.withColumn("k", F.row_number().over(Window.orderBy("theme")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    code = a.stocks(spark, sf_dir).select("code", F.col("code").cast("int").alias("i"))
    themes = code.join(F.broadcast(placed), F.expr("i % (2 * n) = k")).select("code", "theme")
    return links.inherited(code.where("i % 4 = 0").select("code", F.col("i").cast("double").alias("score")), themes, found)
