"""Market-wide measures: per-day cross-sections, pools, boards, temperature and phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import anchor_score, average_rank, clamp, first_true, jaccard, ratio
from barlattice.operators.windows import streak


def pool(changes: DataFrame, up: float | Column, down: float | Column) -> DataFrame:
    """Bars with the streak of days at the upper limit; touched but not held: broke. Limits are numbers, or columns such as those of each stock's venue."""
    flagged = streak(changes, F.col("pct_change") >= up, "streak")
    touched = (ratio(F.col("high"), F.col("prev_close")) * 100 - 100 >= up) & (F.col("pct_change") < up)
    return flagged.withColumn("is_up", F.coalesce(F.col("pct_change") >= up, F.lit(False))).withColumn("is_down", F.coalesce(F.col("pct_change") <= down, F.lit(False))).withColumn("is_broke", F.coalesce(touched, F.lit(False)))


def breadth(changes: DataFrame, up: float, down: float) -> DataFrame:
    """Per day: advances, declines, flats, limits, shares (over max(1, n)), amounts, deviation of changes."""
    pct = F.col("pct_change")
    out = changes.where(pct.isNotNull()).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pct > 0).alias("advance"), F.count_if(pct < 0).alias("decline"), F.count_if(pct == 0).alias("flat"), F.count_if(pct >= up).alias("limit_up"), F.count_if(pct <= down).alias("limit_down"),
        F.round(F.sum("amount"), 2).alias("amount"), F.avg(pct).alias("mean_pct"), F.stddev_samp(pct).alias("std_pct"),
    )
    return out.withColumn("up_share", F.col("advance") / F.greatest(F.col("n"), F.lit(1))).withColumn("down_share", F.col("decline") / F.greatest(F.col("n"), F.lit(1)))


def daily_pool(p: DataFrame) -> DataFrame:
    """Per day: sizes of the pools, highest streak, broke rate, advances and declines."""
    d = p.where(F.col("pct_change").isNotNull()).groupBy("trade_date").agg(
        F.count_if("is_up").alias("limit_up"), F.count_if("is_down").alias("limit_down"), F.count_if("is_broke").alias("broke"), F.max(F.when(F.col("is_up"), F.col("streak"))).alias("max_streak"), F.count_if(F.col("pct_change") > 0).alias("advance"), F.count_if(F.col("pct_change") < 0).alias("decline")
    )
    return d.withColumn("broke_rate", ratio(F.col("broke"), F.col("broke") + F.col("limit_up")))


def temperature(d: DataFrame, scale: float = 1.0) -> DataFrame:
    """Sentiment temperature of five factors; a missing factor counts 50. scale: how many times smaller this market is than one of 5,000 stocks."""
    fifty = lambda c: F.coalesce(c, F.lit(50.0))
    ups = F.when(F.col("limit_up") > 0, F.col("limit_up") * scale)
    parts = {
        "s_limit_up": fifty(anchor_score(ups, 15, 40, 80, 120)), "s_streak": fifty(anchor_score(F.col("max_streak").cast("double"), 2, 4, 6, 8)), "s_broke": fifty(clamp(100 - F.col("broke_rate") / 0.6 * 100)),
        "s_limit_down": clamp(100 - F.col("limit_down") * scale / 60 * 100), "s_breadth": fifty(ratio(F.col("advance"), F.col("advance") + F.col("decline")) * 100),
    }
    out = d.withColumns(parts).withColumn("temperature", 0.30 * F.col("s_limit_up") + 0.25 * F.col("s_streak") + 0.20 * F.col("s_broke") + 0.15 * F.col("s_limit_down") + 0.10 * F.col("s_breadth"))
    return out.withColumn("posture", F.when(F.col("temperature") < 40, "defend").when(F.col("temperature") > 85, "overheated").otherwise("normal"))


def yesterday_feedback(p: DataFrame) -> DataFrame:
    """Per day: how yesterday's limit-ups, first boards and high boards (streak 3 and more) do today; yesterday is the market's previous day."""
    days = p.select("trade_date").distinct().withColumn("next_date", F.lead("trade_date").over(Window.orderBy("trade_date")))
    before = p.where("is_up").select("code", "trade_date", F.col("streak").alias("old_streak")).join(F.broadcast(days), "trade_date").select("code", F.col("next_date").alias("trade_date"), "old_streak")
    met = p.select("code", "trade_date", "pct_change").join(before, ["code", "trade_date"])
    return met.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.avg("pct_change").alias("feedback"), F.avg(F.when(F.col("old_streak") == 1, F.col("pct_change"))).alias("first_board"), F.avg(F.when(F.col("old_streak") >= 3, F.col("pct_change"))).alias("high_board"))


def phase(t: DataFrame, scale: float = 1.0) -> DataFrame:
    """Six-way market phase by an ordered list of rules. t: temperature's result with feedback."""
    temp, ups, downs = F.col("temperature"), F.col("limit_up") * scale, F.col("limit_down") * scale
    breadth_share = F.coalesce(F.nullif(ratio(F.col("advance"), F.col("advance") + F.col("decline")), F.lit(0.0)), F.lit(0.5))
    bad = F.coalesce(F.col("feedback") < -2, F.lit(False))
    broke = F.coalesce(F.col("broke_rate") > 0.35, F.lit(False))
    hot = (temp > 85) | (ups > 100)
    cases = [
        ((temp < 40) | (downs > 50) | ((ups < 15) & (downs > ups)), "ice", F.greatest(F.lit(10), F.floor(temp).cast("int"))),
        (hot & (broke | bad), "divergence", F.lit(75)), (hot, "climax", F.lit(90)),
        (bad & ((temp < 55) | (downs > 20)), "ebb", F.lit(30)),
        (temp.between(60, 85) & (ups >= 40) & (F.coalesce(F.col("max_streak"), F.lit(0)) >= 4) & (breadth_share >= 0.55), "main_rise", F.lit(80)),
        ((temp >= 40) & (temp < 60) & (ups >= 20) & (breadth_share >= 0.5), "repair", F.lit(65)),
    ]
    return t.withColumn("phase", first_true(*[(c, label) for c, label, _ in cases], default="divergence")).withColumn("phase_score", first_true(*[(c, s) for c, _, s in cases], default=F.lit(55)))


#: What each phase allows and forbids.
PHASES = {
    "ice": (["low repair", "dividend defence"], ["chase", "high relay", "short attack"]), "climax": (["core reseal", "wait for pullback"], ["late chase", "high chase"]), "divergence": (["leader support", "core watch"], ["late chase"]),
    "ebb": (["defence watch", "dividend defence"], ["short attack", "chase", "relay"]), "main_rise": (["theme leader", "core trend", "spread", "ladder core"], ["late weak", "no board"]), "repair": (["low reversal", "first board", "strong pullback"], ["high acceleration", "late chase"]),
}


def approximate_pools(changes: DataFrame) -> DataFrame:
    """Per day, from the distribution of changes alone: counts at 9.8, -9.8 and 7 per cent, and guesses of streak, seal and broke rate."""
    p = F.col("pct_change")
    d = changes.where(p.isNotNull()).groupBy("trade_date").agg(F.count(F.lit(1)).alias("total"), F.count_if(p >= 9.8).alias("ups"), F.count_if(p <= -9.8).alias("downs"), F.count_if(p >= 7).alias("strong"))
    seal = F.least(F.lit(0.95), 15 * F.col("ups") / F.greatest(F.col("total"), F.lit(1)))
    return d.withColumn("streak_guess", F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("ups") / 20).cast("int") + 1))).withColumn("seal_rate", seal).withColumn("broke_rate", F.greatest(F.lit(0.05), 1 - seal))


def ladder(p: DataFrame) -> DataFrame:
    """Per day and streak: how many stocks."""
    return p.where("is_up").groupBy("trade_date", "streak").agg(F.count(F.lit(1)).alias("n"))


def pyramid(l: DataFrame, step: float = 15.0) -> DataFrame:
    """Per day: 100 less a penalty for each level that has more stocks than the one below it; 50 with fewer than two levels."""
    w = Window.partitionBy("trade_date").orderBy("streak")
    up = l.withColumn("above", F.lead("n").over(w))
    return up.groupBy("trade_date").agg(F.count(F.lit(1)).alias("levels"), F.count_if(F.col("above") > F.col("n")).alias("inverted")).withColumn("score", F.when(F.col("levels") < 2, 50.0).otherwise(clamp(100 - step * F.col("inverted"))))


def theme_strength(p: DataFrame, theme: str) -> DataFrame:
    """Per theme of one day's limit-up pool: count, summed and highest streak, median cap, score n + half the streaks, place."""
    g = p.groupBy(theme).agg(F.count(F.lit(1)).alias("n"), F.sum("streak").alias("streaks"), F.max("streak").alias("top_streak"), F.median("circ_mv_yi").alias("median_cap"))
    g = g.withColumn("strength", F.col("n") + 0.5 * F.col("streaks"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("strength"), theme)))


def leaderboards(s: DataFrame, size: int = 10) -> DataFrame:
    """Seven boards of a snapshot: the first rows of each by its column, ties by code."""
    boards = {"gainers": ("pct_change", False), "losers": ("pct_change", True), "volume": ("volume", False), "turnover": ("turnover_rate", False), "net_inflow": ("main_net", False), "net_outflow": ("main_net", True), "cap": ("circ_mv_yi", False)}
    named = F.array(*[F.struct(F.lit(b).alias("leaderboard"), (F.col(c) if up else -F.col(c)).cast("double").alias("key"), F.col(c).cast("double").alias("value")) for b, (c, up) in boards.items()])
    # an array of seven and a partial top-k per group: one pass over the snapshot
    long = s.select("code", F.explode(named).alias("x")).select("code", "x.*").where("key IS NOT NULL")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("leaderboard").orderBy("key", "code"))).where(F.col("place") <= size).select("leaderboard", "place", "code", "value")


def sector_rotation(f: DataFrame) -> DataFrame:
    """f: board, net1, net5, net10. Rotation score of the percentile ranks; a missing rank counts 50."""
    whole = Window.partitionBy()
    for n in (1, 5, 10):
        x = F.col(f"net{n}")
        f = f.withColumn(f"r{n}", F.when(x.isNotNull(), average_rank(x, whole, Window.partitionBy(x.isNull()).orderBy(x), Window.partitionBy(x))))
        f = f.withColumn(f"r{n}", F.coalesce(f"r{n}", F.lit(50.0)))
    return f.withColumn("rotation", 0.4 * clamp(50 + 0.8 * (F.col("r5") - F.col("r10"))) + 0.4 * F.col("r5") + 0.2 * F.col("r1"))


def leaders(board_day: DataFrame, n: int = 10) -> DataFrame:
    """Per day the n boards with the largest change, as an array; with the day before's, and those of the last three days together."""
    top = board_day.withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("pct"), "board"))).where(F.col("place") <= n)
    days = top.groupBy("trade_date").agg(F.sort_array(F.collect_list("board")).alias("now"))
    w = Window.orderBy("trade_date")
    three = F.array_distinct(F.flatten(F.collect_list("now").over(w.rowsBetween(-3, -1))))
    return days.withColumn("before", F.lag("now").over(w)).withColumn("three", three)


def rotation_speed(l: DataFrame) -> DataFrame:
    """Persistence of leaders and a speed score from it."""
    one, many = jaccard(F.col("now"), F.col("before")), jaccard(F.col("now"), F.col("three"))
    out = l.where("before IS NOT NULL").withColumn("j1", one).withColumn("j3", many).withColumn("persistence", 0.6 * F.col("j1") + 0.4 * F.col("j3"))
    return out.withColumn("score", anchor_score(F.col("persistence") * 100, 10, 25, 50, 75))


def board_ranking(board: DataFrame) -> DataFrame:
    """Boards by z-score of their change, less a penalty where they don't persist. board: board, pct, persistence."""
    whole = Window.partitionBy()
    sd = F.stddev_samp("pct").over(whole)
    z = F.when(sd > 0, (F.col("pct") - F.avg("pct").over(whole)) / sd).otherwise(0.0)
    return board.withColumn("z", z).withColumn("score", F.col("z") * 0.6 - F.when(F.col("persistence") < 0.3, 0.2).otherwise(0.0))


def hot_boards(s: DataFrame, top: int = 200) -> DataFrame:
    """Boards of the stocks that gained most: half the mean change plus half the count, with two stocks or more."""
    best = s.orderBy(F.desc("pct_change"), "code").limit(top)
    g = best.groupBy("board").agg(F.avg("pct_change").alias("avg_pct"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return g.where("n >= 2").withColumn("heat", F.col("avg_pct") * 0.5 + F.col("n") * 0.5)


def market_signals(d: DataFrame) -> DataFrame:
    """Peak, bottom and divergence flags: two or more of their factors."""
    n = lambda *c: sum((F.when(x, 1).otherwise(0) for x in c), F.lit(0))
    return d.withColumns({
        "peak": n(F.col("temperature") > 80, F.col("max_streak") >= 4, F.col("broke_rate") > 0.35) >= 2,
        "bottom": n(F.col("temperature") < 40, F.col("limit_down") > F.col("limit_up"), F.col("s_breadth") < 30) >= 2,
        "diverging": n(F.col("broke_rate") > 0.35, F.col("feedback") < -2, (F.col("limit_up") > 0) & (F.col("limit_down") > 0)) >= 2,
    })


def ma_breadth(f: DataFrame) -> DataFrame:
    """Per day: share of stocks with ma5 > ma10 > ma20, and above ma20, of those with 21 rows or more."""
    return f.where("rn >= 21").groupBy("trade_date").agg(F.avg(F.when((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")), 1.0).otherwise(0.0)).alias("bull_share"), F.avg(F.when(F.col("close") > F.col("ma20"), 1.0).otherwise(0.0)).alias("above_share"), F.avg(ratio(F.col("close") - F.col("ma20"), F.col("ma20")) * 100).alias("mean_gap"))


def combined(components: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of scores; weights are normalised, a missing score counts 50."""
    total = sum(w for _, w in components.values())
    return sum((F.coalesce(c, F.lit(50.0)) * (w / total) for c, w in components.values()), F.lit(0.0))


#: The weights of the parts of the market's structure. Three more parts are known, of weight 0: broke rate, first against high boards, strong pool.
STRUCTURE = {"limit_up": 0.13, "height": 0.10, "limit_down": 0.09, "breadth": 0.08, "strong": 0.09, "ma_bull": 0.09, "above_ma20": 0.09, "volatility": 0.08, "rotation": 0.08, "seal": 0.09, "ladder": 0.08}


def ladder_health(l: DataFrame, step: float = 25.0) -> DataFrame:
    """Per day: 100 less step times the ratio of each level to a smaller one below it; 50 with fewer than two levels."""
    up = l.withColumn("above", F.lead("n").over(Window.partitionBy("trade_date").orderBy("streak")))
    lost = F.coalesce(F.sum(F.when(F.col("above") > F.col("n"), F.col("above") / F.col("n"))), F.lit(0.0))
    return up.groupBy("trade_date").agg(F.when(F.count(F.lit(1)) < 2, 50.0).otherwise(clamp(100 - step * lost)).alias("ladder_health"))


def structure_days(p: DataFrame, ma: DataFrame, rotation: DataFrame) -> DataFrame:
    """What structure() reads, per day. p: pool's result, ma: ma_breadth's, rotation: rotation_speed's."""
    pct = F.col("pct_change")
    spread = p.where(pct.isNotNull()).groupBy("trade_date").agg((F.count_if(pct > 5) / F.count(F.lit(1))).alias("strong_share"), F.stddev_samp(pct).alias("sd"))
    guess = approximate_pools(p).select("trade_date", "ups", "downs", "streak_guess", F.col("seal_rate").alias("seal_guess"))
    out = daily_pool(p)
    for x in (spread, guess, ladder_health(ladder(p)), ma.select("trade_date", "bull_share", "above_share"), rotation.select("trade_date", "j1")):
        out = out.join(x, "trade_date", "left")
    return out


def structure(d: DataFrame, scale: float = 1.0) -> DataFrame:
    """d with p_<part> of every weighted part, approximate, and structure: their weighted mean, a missing part counting 50.

    On a day whose pools are all empty, limits, height and seal rate are guessed from the distribution of changes and the ladder counts 50.
    Leaders without a day before them count as half persistent. scale: as in temperature().
    """
    whole = (F.col("limit_up") + F.col("broke") + F.col("limit_down")) > 0
    pick = lambda a, b: F.when(whole, a).otherwise(b)
    sealed = F.coalesce(ratio(F.col("limit_up"), F.col("limit_up") + F.col("broke")), F.lit(0.0))
    parts = {
        "limit_up": anchor_score(pick(F.col("limit_up"), F.col("ups")) * scale, 15, 40, 80, 120), "height": anchor_score(pick(F.coalesce("max_streak", F.lit(0)), F.col("streak_guess")).cast("double"), 2, 4, 6, 8),
        "limit_down": clamp(100 - pick(F.col("limit_down"), F.col("downs")) * scale / 60 * 100), "breadth": ratio(F.col("advance"), F.col("advance") + F.col("decline")) * 100,
        "strong": anchor_score(F.col("strong_share") * 100, 2, 5, 15, 25), "ma_bull": anchor_score(F.col("bull_share") * 100, 10, 30, 60, 80), "above_ma20": anchor_score(F.col("above_share") * 100, 15, 35, 65, 85),
        "volatility": F.bround(clamp(100 - (F.col("sd") - 3) / 3 * 100), 1), "rotation": anchor_score(F.coalesce("j1", F.lit(0.5)) * 100, 20, 40, 65, 85),
        "seal": clamp(pick(sealed, F.col("seal_guess")) * 100), "ladder": F.bround(pick(F.col("ladder_health"), F.lit(50.0)), 1),
    }
    out = d.withColumns({"approximate": ~whole, **{f"p_{k}": c for k, c in parts.items()}})
    return out.withColumn("structure", combined({k: (F.col(f"p_{k}"), w) for k, w in STRUCTURE.items()}))
