"""Market-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import clamp, up_limit
from barlattice.operators import market as m
from barlattice.operators import windows as w
from barlattice.plans.common import Catalogue, r, with_ctes
from barlattice.sources import adapters as a

CATALOGUE = Catalogue()
add = CATALOGUE.add
UP, DOWN = a.UP_LIMIT, a.DOWN_LIMIT
DAY = f"DATE '{a.AS_OF}'"

POOL = f"""pool AS (SELECT *, CASE WHEN pct_change >= {UP} THEN count(*) FILTER (pct_change >= {UP}) OVER (PARTITION BY code, island ORDER BY trade_date) ELSE 0 END AS streak, coalesce(pct_change >= {UP}, false) AS is_up, coalesce(pct_change <= {DOWN}, false) AS is_down,
  coalesce(high / prev_close * 100 - 100 >= {UP} AND pct_change < {UP}, false) AS is_broke
  FROM (SELECT *, sum(CASE WHEN pct_change >= {UP} THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY trade_date) AS island FROM ch))"""
DAYPOOL = POOL + """, dp AS (SELECT *, broke / nullif(broke + limit_up, 0) AS broke_rate FROM (SELECT trade_date, count(*) FILTER (is_up) AS limit_up, count(*) FILTER (is_down) AS limit_down, count(*) FILTER (is_broke) AS broke, max(CASE WHEN is_up THEN streak END) AS max_streak,
  count(*) FILTER (pct_change > 0) AS advance, count(*) FILTER (pct_change < 0) AS decline FROM pool WHERE pct_change IS NOT NULL GROUP BY 1))"""


def anchor_sql(x: str, a1: float, a2: float, a3: float, a4: float) -> str:
    return f"CASE WHEN {x} <= {a1} THEN 0.0 WHEN {x} <= {a2} THEN ({x} - {a1}) / {float(a2 - a1)} * 50 WHEN {x} <= {a3} THEN 50 + ({x} - {a2}) / {float(a3 - a2)} * 35 WHEN {x} <= {a4} THEN 85 + ({x} - {a3}) / {float(a4 - a3)} * 15 WHEN {x} IS NOT NULL THEN 100.0 END"


TEMP = DAYPOOL + f""", tp AS (SELECT *, 0.3 * s_limit_up + 0.25 * s_streak + 0.2 * s_broke + 0.15 * s_limit_down + 0.1 * s_breadth AS temperature FROM (SELECT *,
  coalesce({anchor_sql('CASE WHEN limit_up > 0 THEN limit_up * 5.0 END', 15, 40, 80, 120)}, 50) AS s_limit_up, coalesce({anchor_sql('max_streak', 2, 4, 6, 8)}, 50) AS s_streak, CASE WHEN broke_rate IS NULL THEN 50 ELSE least(greatest(100 - broke_rate / 0.6 * 100, 0), 100) END AS s_broke,
  least(greatest(100 - limit_down * 5.0 / 60 * 100, 0), 100) AS s_limit_down, coalesce(advance / nullif(advance + decline, 0) * 100, 50) AS s_breadth FROM dp))"""
FEEDBACK = """fb AS (SELECT p.trade_date, count(*) AS n, avg(p.pct_change) AS feedback, avg(CASE WHEN q.streak = 1 THEN p.pct_change END) AS first_board, avg(CASE WHEN q.streak >= 3 THEN p.pct_change END) AS high_board
  FROM pool p JOIN (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS before FROM (SELECT DISTINCT trade_date FROM pool)) d USING (trade_date) JOIN pool q ON q.code = p.code AND q.trade_date = d.before AND q.is_up GROUP BY 1)"""
SCALE = 5.0


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.changes(a.bars(spark, sf_dir))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pool(changes(spark, sf_dir), UP, DOWN)


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.temperature(m.daily_pool(pool(spark, sf_dir)), SCALE)


def with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    return m.temperature(m.daily_pool(p), SCALE).join(m.yesterday_feedback(p).drop("n"), "trade_date", "left")


@add("breadth", with_ctes("ch") + f"""SELECT trade_date, count(*) AS n, count(*) FILTER (pct_change > 0) AS advance, count(*) FILTER (pct_change < 0) AS decline, count(*) FILTER (pct_change = 0) AS flat, count(*) FILTER (pct_change >= {UP}) AS limit_up, count(*) FILTER (pct_change <= {DOWN}) AS limit_down,
round(sum(amount), 2) AS amount, round(avg(pct_change), 4) AS mean_pct, round(stddev_samp(pct_change), 4) AS std_pct, round(count(*) FILTER (pct_change > 0) / count(*), 6) AS up_share, round(count(*) FILTER (pct_change < 0) / count(*), 6) AS down_share FROM ch WHERE pct_change IS NOT NULL GROUP BY 1""")
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = m.breadth(changes(spark, sf_dir), UP, DOWN)
    return d.withColumns({"mean_pct": r("mean_pct", 4), "std_pct": r("std_pct", 4), "up_share": r("up_share"), "down_share": r("down_share")})


@add("sentiment_temperature", with_ctes("ch", more=TEMP) + "SELECT trade_date, limit_up, limit_down, max_streak, round(broke_rate, 6) AS broke_rate, round(temperature, 4) AS temperature, CASE WHEN temperature < 40 THEN 'defend' WHEN temperature > 85 THEN 'overheated' ELSE 'normal' END AS posture FROM tp")
def sentiment_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature(spark, sf_dir).select("trade_date", "limit_up", "limit_down", "max_streak", r("broke_rate"), r("temperature", 4), "posture")


@add("yesterday_feedback", with_ctes("ch", more=POOL + ", " + FEEDBACK) + "SELECT trade_date, n, round(feedback, 4) AS feedback, round(first_board, 4) AS first_board, round(high_board, 4) AS high_board FROM fb")
def yesterday_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.yesterday_feedback(pool(spark, sf_dir)).select("trade_date", "n", r("feedback", 4), r("first_board", 4), r("high_board", 4))


PHASE = f"""ph AS (SELECT *, coalesce(feedback < -2, false) AS bad, coalesce(broke_rate > 0.35, false) AS brk, limit_up * {SCALE} AS ups, limit_down * {SCALE} AS downs, coalesce(nullif(advance / nullif(advance + decline, 0), 0), 0.5) AS adv FROM tp LEFT JOIN (SELECT trade_date, feedback FROM fb) USING (trade_date))"""


def phase_case(kinds: tuple[str, ...]) -> str:
    tests = ["temperature < 40 OR downs > 50 OR (ups < 15 AND downs > ups)", "(temperature > 85 OR ups > 100) AND (brk OR bad)", "temperature > 85 OR ups > 100", "bad AND (temperature < 55 OR downs > 20)", "temperature BETWEEN 60 AND 85 AND ups >= 40 AND coalesce(max_streak, 0) >= 4 AND adv >= 0.55", "temperature >= 40 AND temperature < 60 AND ups >= 20 AND adv >= 0.5"]
    return "CASE " + " ".join(f"WHEN {t} THEN {k}" for t, k in zip(tests, kinds[:-1], strict=True)) + f" ELSE {kinds[-1]} END"


@add("market_phase", with_ctes("ch", more=TEMP + ", " + FEEDBACK + ", " + PHASE) + "SELECT trade_date, " + phase_case(("'ice'", "'divergence'", "'climax'", "'ebb'", "'main_rise'", "'repair'", "'divergence'")) + " AS phase, " + phase_case(("greatest(10, CAST(floor(temperature) AS INTEGER))", "75", "90", "30", "80", "65", "55")) + " AS phase_score FROM ph")
def market_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.phase(with_feedback(spark, sf_dir), SCALE).select("trade_date", "phase", "phase_score")


@add("market_signals", with_ctes("ch", more=TEMP + ", " + FEEDBACK) + """SELECT trade_date, (CASE WHEN temperature > 80 THEN 1 ELSE 0 END + CASE WHEN max_streak >= 4 THEN 1 ELSE 0 END + CASE WHEN broke_rate > 0.35 THEN 1 ELSE 0 END) >= 2 AS peak,
(CASE WHEN temperature < 40 THEN 1 ELSE 0 END + CASE WHEN limit_down > limit_up THEN 1 ELSE 0 END + CASE WHEN s_breadth < 30 THEN 1 ELSE 0 END) >= 2 AS bottom, (CASE WHEN broke_rate > 0.35 THEN 1 ELSE 0 END + CASE WHEN feedback < -2 THEN 1 ELSE 0 END + CASE WHEN limit_up > 0 AND limit_down > 0 THEN 1 ELSE 0 END) >= 2 AS diverging
FROM tp LEFT JOIN (SELECT trade_date, feedback FROM fb) USING (trade_date)""")
def market_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.market_signals(with_feedback(spark, sf_dir)).select("trade_date", "peak", "bottom", "diverging")


@add("approx_pools", with_ctes("ch") + """SELECT *, round(greatest(0.05, 1 - s), 6) AS broke_rate, round(s, 6) AS seal_rate, least(5, greatest(1, CAST(floor(ups / 20) AS INTEGER) + 1)) AS streak_guess FROM (SELECT *, least(0.95, 15 * ups / greatest(total, 1)) AS s FROM (SELECT trade_date, count(*) AS total, count(*) FILTER (pct_change >= 9.8) AS ups, count(*) FILTER (pct_change <= -9.8) AS downs, count(*) FILTER (pct_change >= 7) AS strong FROM ch WHERE pct_change IS NOT NULL GROUP BY 1))""".replace("SELECT *, round(greatest", "SELECT trade_date, total, ups, downs, strong, round(greatest"))
def approx_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.approximate_pools(changes(spark, sf_dir)).withColumns({"seal_rate": r("seal_rate"), "broke_rate": r("broke_rate")})


@add("ladder_histogram", with_ctes("ch", more=POOL) + "SELECT trade_date, streak, count(*) AS n FROM pool WHERE is_up GROUP BY 1, 2")
def ladder_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ladder(pool(spark, sf_dir)).withColumn("streak", F.col("streak").cast("long"))


@add("pyramid_score", with_ctes("ch", more=POOL) + "SELECT trade_date, count(*) AS levels, count(*) FILTER (above > n) AS inverted, CASE WHEN count(*) < 2 THEN 50.0 ELSE CAST(greatest(0, 100 - 15.0 * count(*) FILTER (above > n)) AS DOUBLE) END AS score FROM (SELECT *, lead(n) OVER (PARTITION BY trade_date ORDER BY streak) AS above FROM (SELECT trade_date, streak, count(*) AS n FROM pool WHERE is_up GROUP BY 1, 2)) GROUP BY 1")
def pyramid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pyramid(m.ladder(pool(spark, sf_dir)))


#: A day on which this data has limit-ups.
def pool_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = pool(spark, sf_dir).where(F.col("is_up") & (F.col("trade_date") <= F.lit(a.AS_OF).cast("date")) & (F.col("trade_date") > F.date_sub(F.lit(a.AS_OF).cast("date"), 60)))
    return window.join(a.stocks(spark, sf_dir), "code")


@add("theme_strength", with_ctes("ch", "stocks", more=POOL) + f"SELECT *, row_number() OVER (ORDER BY strength DESC, board) AS place FROM (SELECT board, count(*) AS n, CAST(sum(streak) AS BIGINT) AS streaks, max(streak) AS top_streak, median(circ_mv_yi) AS median_cap, count(*) + 0.5 * CAST(sum(streak) AS BIGINT) AS strength FROM pool JOIN stocks USING (code) WHERE is_up AND trade_date <= {DAY} AND trade_date > {DAY} - 60 GROUP BY 1)")
def theme_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.theme_strength(pool_of_day(spark, sf_dir), "board").withColumn("strength", F.col("strength").cast("double"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date"))
    last = f.groupBy("code").agg(F.max_by("main_net", "trade_date").alias("main_net"))
    return a.spot(spark, sf_dir).join(last, "code", "left")


@add("leaderboards", with_ctes("spot", "flows", more=f"q AS (SELECT spot.*, main_net FROM spot LEFT JOIN (SELECT code, arg_max(main_net, trade_date) AS main_net FROM flows WHERE trade_date <= {DAY} GROUP BY 1) USING (code))") + "SELECT leaderboard, place, code, round(value, 4) AS value FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS leaderboard, row_number() OVER (ORDER BY {c} {d}, code) AS place, code, CAST({c} AS DOUBLE) AS value FROM q WHERE {c} IS NOT NULL" for b, c, d in (("gainers", "pct_change", "DESC"), ("losers", "pct_change", ""), ("volume", "volume", "DESC"), ("turnover", "turnover_rate", "DESC"), ("net_inflow", "main_net", "DESC"), ("net_outflow", "main_net", ""), ("cap", "circ_mv_yi", "DESC"))) + ") WHERE place <= 10")
def leaderboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.leaderboards(quotes(spark, sf_dir)).withColumn("value", r("value", 4))


@add("sector_rotation", with_ctes("bars", "flows", "stocks", more=f"n AS (SELECT board, " + ", ".join(f"round(sum(main_net) FILTER (back <= {k}), 2) AS net{k}" for k in (1, 5, 10)) + f" FROM (SELECT *, dense_rank() OVER (ORDER BY trade_date DESC) AS back FROM flows WHERE trade_date <= {DAY}) JOIN stocks USING (code) WHERE back <= 10 GROUP BY 1), k AS (SELECT *, " + ", ".join(f"coalesce(CASE WHEN net{k} IS NOT NULL THEN (rank() OVER (PARTITION BY net{k} IS NULL ORDER BY net{k}) + (count(net{k}) OVER (PARTITION BY net{k}) - 1) / 2.0) / count(net{k}) OVER () * 100 END, 50) AS r{k}" for k in (1, 5, 10)) + " FROM n)") + "SELECT board, net1, net5, net10, round(0.4 * least(greatest(50 + 0.8 * (r5 - r10), 0), 100) + 0.4 * r5 + 0.2 * r1, 6) AS rotation FROM k")
def sector_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).where(F.col("trade_date") <= F.lit(a.AS_OF).cast("date"))
    days = f.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(10).withColumn("back", F.row_number().over(Window.orderBy(F.desc("trade_date"))))
    met = f.join(F.broadcast(days), "trade_date").join(a.stocks(spark, sf_dir).select("code", "board"), "code")
    nets = met.groupBy("board").agg(*[F.round(F.sum(F.when(F.col("back") <= k, F.col("main_net"))), 2).alias(f"net{k}") for k in (1, 5, 10)])
    return m.sector_rotation(nets).select("board", "net1", "net5", "net10", r("rotation"))


BOARDDAY = "bd AS (SELECT trade_date, board, avg(pct_change) AS pct FROM ch JOIN stocks USING (code) WHERE pct_change IS NOT NULL GROUP BY 1, 2), tb AS (SELECT trade_date, list(board ORDER BY board) AS now FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY pct DESC, board) AS place FROM bd) WHERE place <= 10 GROUP BY 1), ld AS (SELECT trade_date, now, lag(now) OVER (ORDER BY trade_date) AS before, list_distinct(flatten(list(now) OVER (ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))) AS three FROM tb)"


def jaccard_sql(x: str, y: str) -> str:
    return f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))"


@add("leader_jaccard", with_ctes("ch", "stocks", more=BOARDDAY) + f"SELECT trade_date, round(j1, 6) AS j1, round(j3, 6) AS j3, round(0.6 * j1 + 0.4 * j3, 6) AS persistence, round({anchor_sql('(0.6 * j1 + 0.4 * j3) * 100', 10, 25, 50, 75)}, 4) AS score FROM (SELECT trade_date, {jaccard_sql('now', 'before')} AS j1, {jaccard_sql('now', 'three')} AS j3 FROM ld WHERE before IS NOT NULL)")
def leader_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes(spark, sf_dir).where("pct_change IS NOT NULL").join(a.stocks(spark, sf_dir).select("code", "board"), "code")
    d = m.rotation_speed(m.leaders(c.groupBy("trade_date", "board").agg(F.avg("pct_change").alias("pct"))))
    return d.select("trade_date", r("j1"), r("j3"), r("persistence"), r("score", 4))


@add("board_ranking", with_ctes("spot") + "SELECT board, round(z, 6) AS z, round(z * 0.6 - CASE WHEN persistence < 0.3 THEN 0.2 ELSE 0.0 END, 6) AS score FROM (SELECT *, CASE WHEN stddev_samp(pct) OVER () > 0 THEN (pct - avg(pct) OVER ()) / stddev_samp(pct) OVER () ELSE 0.0 END AS z FROM (SELECT board, avg(pct_change) AS pct, avg(CASE WHEN pct_change > 0 THEN 1.0 ELSE 0.0 END) AS persistence FROM spot GROUP BY 1))")
def board_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.spot(spark, sf_dir).groupBy("board").agg(F.avg("pct_change").alias("pct"), F.avg(F.when(F.col("pct_change") > 0, 1.0).otherwise(0.0)).alias("persistence"))
    return m.board_ranking(b).select("board", r("z"), r("score"))


@add("hot_boards", with_ctes("spot") + "SELECT board, round(avg(pct_change), 4) AS avg_pct, count(*) AS n, round(sum(amount), 2) AS amount, round(avg(pct_change) * 0.5 + count(*) * 0.5, 4) AS heat FROM (SELECT * FROM spot ORDER BY pct_change DESC, code LIMIT 200) GROUP BY 1 HAVING count(*) >= 2")
def hot_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.hot_boards(a.spot(spark, sf_dir)).select("board", r("avg_pct", 4), "n", r("amount", 2), r("heat", 4))


@add("ma_breadth", with_ctes("feat") + "SELECT trade_date, round(avg(CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 1.0 ELSE 0.0 END), 6) AS bull_share, round(avg(CASE WHEN close > ma20 THEN 1.0 ELSE 0.0 END), 6) AS above_share, round(avg((close - ma20) / ma20 * 100), 4) AS mean_gap FROM feat WHERE rn >= 21 GROUP BY 1")
def ma_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ma_breadth(w.features(a.bars(spark, sf_dir))).select("trade_date", r("bull_share"), r("above_share"), r("mean_gap", 4))


@add("market_structure", with_ctes("ch", more=TEMP + ", " + FEEDBACK) + f"SELECT trade_date, round((coalesce(s_limit_up, 50) * 3 + coalesce(s_streak, 50) * 2 + coalesce(s_broke, 50) * 2 + coalesce(s_limit_down, 50) + coalesce(s_breadth, 50) + CASE WHEN feedback IS NULL THEN 50 ELSE least(greatest(50 + feedback / 10, 0), 100) END) / 10, 4) AS structure FROM tp LEFT JOIN (SELECT trade_date, feedback FROM fb) USING (trade_date)")
def market_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_feedback(spark, sf_dir)
    parts = {"limit_up": (F.col("s_limit_up"), 3), "streak": (F.col("s_streak"), 2), "broke": (F.col("s_broke"), 2), "down": (F.col("s_limit_down"), 1), "breadth": (F.col("s_breadth"), 1), "feedback": (clamp(50 + F.col("feedback") / 10), 1)}
    return d.select("trade_date", r(m.combined(parts), 4, "structure"))


WHOLE = DAYPOOL + ", " + BOARDDAY + f""", mb AS (SELECT trade_date, avg(CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 1.0 ELSE 0.0 END) * 100 AS bull, avg(CASE WHEN close > ma20 THEN 1.0 ELSE 0.0 END) * 100 AS above FROM feat WHERE rn >= 21 GROUP BY 1),
  sp AS (SELECT trade_date, count(*) AS total, count(*) FILTER (pct_change >= 9.8) AS ups, count(*) FILTER (pct_change <= -9.8) AS downs, count(*) FILTER (pct_change > 5) / count(*) * 100 AS strong, stddev_samp(pct_change) AS sd FROM ch WHERE pct_change IS NOT NULL GROUP BY 1),
  lh AS (SELECT trade_date, CASE WHEN count(*) < 2 THEN 50.0 ELSE greatest(0, 100 - 25.0 * coalesce(sum(above / n) FILTER (above > n), 0)) END AS health FROM (SELECT *, lead(n) OVER (PARTITION BY trade_date ORDER BY streak) AS above FROM (SELECT trade_date, streak, count(*) AS n FROM pool WHERE is_up GROUP BY 1, 2)) GROUP BY 1),
  al AS (SELECT *, limit_up + broke + limit_down = 0 AS guessed, CASE WHEN before IS NOT NULL THEN {jaccard_sql('now', 'before')} ELSE 0.5 END * 100 AS overlap FROM dp JOIN sp USING (trade_date) LEFT JOIN lh USING (trade_date) LEFT JOIN mb USING (trade_date) LEFT JOIN ld USING (trade_date)),
  cm AS (SELECT *, (CASE WHEN guessed THEN ups ELSE limit_up END) * {SCALE} AS n_up, (CASE WHEN guessed THEN downs ELSE limit_down END) * {SCALE} AS n_down, CASE WHEN guessed THEN least(5, greatest(1, ups // 20 + 1)) ELSE coalesce(max_streak, 0) END AS height,
    CASE WHEN guessed THEN least(0.95, 15 * ups / total) WHEN limit_up + broke > 0 THEN limit_up / (limit_up + broke) ELSE 0.0 END * 100 AS seal, round_even(least(greatest(100 - (sd - 3) / 3 * 100, 0), 100), 1) AS calm, round_even(CASE WHEN guessed THEN 50.0 ELSE health END, 1) AS rungs FROM al)"""


@add("market_structure_full", with_ctes("ch", "stocks", "feat", more=WHOLE) + f"SELECT trade_date, guessed AS approximate, round(0.13 * {anchor_sql('n_up', 15, 40, 80, 120)} + 0.10 * {anchor_sql('height', 2, 4, 6, 8)} + 0.09 * least(greatest(100 - n_down / 60 * 100, 0), 100) + 0.08 * coalesce(advance / nullif(advance + decline, 0) * 100, 50) + 0.09 * {anchor_sql('strong', 2, 5, 15, 25)} + 0.09 * coalesce({anchor_sql('bull', 10, 30, 60, 80)}, 50) + 0.09 * coalesce({anchor_sql('above', 15, 35, 65, 85)}, 50) + 0.08 * CASE WHEN sd IS NULL THEN 50 ELSE calm END + 0.08 * {anchor_sql('overlap', 20, 40, 65, 85)} + 0.09 * seal + 0.08 * coalesce(rungs, 50), 4) AS structure FROM cm")
def market_structure_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    boards = p.where("pct_change IS NOT NULL").join(a.stocks(spark, sf_dir).select("code", "board"), "code").groupBy("trade_date", "board").agg(F.avg("pct_change").alias("pct"))
    d = m.structure_days(p, m.ma_breadth(w.features(a.bars(spark, sf_dir))), m.rotation_speed(m.leaders(boards)))
    return m.structure(d, SCALE).select("trade_date", "approximate", r("structure", 4))


@add("venue_pools", with_ctes("ch", more="""v AS (SELECT * EXCLUDE (code), lpad(CAST(CAST(code AS INTEGER) * 36731 % 1000000 AS VARCHAR), 6, '0') AS code FROM ch),
l AS (SELECT *, CASE WHEN substr(code, 1, 2) IN ('30', '68') THEN 19.5 ELSE 9.5 END AS up FROM v),
p AS (SELECT *, CASE WHEN pct_change >= up THEN count(*) FILTER (pct_change >= up) OVER (PARTITION BY code, island ORDER BY trade_date) ELSE 0 END AS streak FROM (SELECT *, sum(CASE WHEN pct_change >= up THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY trade_date) AS island FROM l))""")
+ "SELECT trade_date, up, count(*) FILTER (pct_change >= up) AS limit_up, count(*) FILTER (pct_change <= -up) AS limit_down, count(*) FILTER (high / prev_close * 100 - 100 >= up AND pct_change < up) AS broke, max(CASE WHEN pct_change >= up THEN streak END) AS max_streak FROM p WHERE pct_change IS NOT NULL GROUP BY 1, 2")
def venue_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools of each day by the limit of the stocks' venue: 20 per cent venues beside the others. Codes are spread over all venues."""
    # as longs: from code 058466 on the product is beyond an int. No two codes share a venue's code, so streaks go by the code that rows are dealt by
    venue = F.lpad((F.col("code").cast("long") * 36_731 % 1_000_000).cast("string"), 6, "0")
    changes = a.changes(a.bars(spark, sf_dir)).withColumn("up", up_limit(venue))
    p = m.pool(changes, F.col("up"), -F.col("up")).where("pct_change IS NOT NULL")
    return p.groupBy("trade_date", "up").agg(F.count_if("is_up").alias("limit_up"), F.count_if("is_down").alias("limit_down"), F.count_if("is_broke").alias("broke"), F.max(F.when(F.col("is_up"), F.col("streak"))).alias("max_streak"))
