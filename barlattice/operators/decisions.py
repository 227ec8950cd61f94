"""The decision layer: evidence, quality verdicts, theme maps, candidates on demand, market narrative, lookups by code.

All are joins and aggregates by code, theme, run or day; lists that end in a report are cut to a fixed length by ranking, not by collecting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import ratio
from barlattice.operators.ranking import numbered, running_total
from barlattice.sources.quality import by_priority


def best_signal(signals: DataFrame) -> DataFrame:
    """code, strategy, score, trigger: each code's strongest signal."""
    return signals.groupBy("code").agg(F.max_by(F.struct("strategy", "score", "trigger"), F.struct(F.coalesce("score", F.lit(0.0)), "strategy")).alias("s")).select("code", "s.*")


def evidence(buckets: dict[str, DataFrame], signals: DataFrame, guards: DataFrame, phase: str | None = None, quality: str = "unknown") -> DataFrame:
    """A row per code of the buckets (the first bucket that has it decides; each has code, name, close, pct_change, rps, turnover_rate, circ_mv_yi): its status and structs of strategy, price action, liquidity and quality."""
    merged = by_priority([b.withColumn("status", F.lit(k)) for k, b in buckets.items()], ["code"])
    s, g = best_signal(signals).withColumnRenamed("score", "signal_score"), guards.select("code", F.col("guard_status").alias("guarded"))
    return evidence_of(merged.join(s, "code", "left").join(g, "code", "left"), phase, quality)


def evidence_of(rows: DataFrame, phase: str | None = None, quality: str = "unknown") -> DataFrame:
    """The same of rows that have status, strategy, signal_score, trigger and guarded already."""
    missing = F.col("turnover_rate").isNull()
    return rows.select(
        "code", "name", "status", F.coalesce("guarded", F.lit("unknown")).alias("guarded_state"),
        F.struct("strategy", F.col("signal_score").alias("score"), "trigger", F.lit(phase).alias("market_phase"), F.col("strategy").isNull().alias("is_trend_only")).alias("strategy_evidence"),
        F.struct("close", "pct_change", "rps").alias("price_action"),
        F.struct("turnover_rate", F.when(missing, "missing").otherwise("ok").alias("turnover_status"), missing.alias("turnover_missing"), "circ_mv_yi").alias("liquidity"),
        F.lit(quality).alias("data_quality"),
    )


#: Sources whose failure fails a report; those that degrade it unless they are ok; those that degrade it when failed or degraded.
CORE, MUST_BE_OK, MAY_DEGRADE = ("all_spot", "daily_kline", "entry_exit"), ("rps",), ("fund_flow", "entry_exit", "quant_guard", "volume_audit")


def quality_verdict(states: DataFrame, fields: DataFrame, most_missing: float = 0.3) -> DataFrame:
    """run, verdict, tradable, n_failed, n_degraded. states: run, source, status; fields: run, close, pct_change, turnover_rate, is_final.

    Failed: a core source failed, or over 30 per cent of a core field's values are missing. Degraded: strength isn't ok, or flows, plans, guards or volumes are failed or degraded. Tradable: ok, with a final candidate."""
    status = lambda s: F.max(F.when(F.col("source") == s, F.col("status")))
    per = states.groupBy("run").agg(*[status(s).alias(f"s_{s}") for s in dict.fromkeys([*CORE, *MUST_BE_OK, *MAY_DEGRADE])])
    core = ("close", "pct_change", "turnover_rate")
    gaps = fields.groupBy("run").agg(*[F.avg(F.when(F.col(c).isNull() | F.isnan(c), 1.0).otherwise(0.0)).alias(f"m_{c}") for c in core], F.count_if("is_final").alias("n_final"))
    one = lambda test: F.when(test, 1).otherwise(0)
    lost = F.greatest(*[F.coalesce(f"m_{c}", F.lit(0.0)) for c in core]) > most_missing
    out = per.join(gaps, "run", "left").withColumn("n_failed", sum((one(F.col(f"s_{s}") == "failed") for s in CORE), one(lost)))
    degraded = sum((one(F.col(f"s_{s}").isin("failed", "degraded")) for s in MAY_DEGRADE), sum((one(F.coalesce(f"s_{s}", F.lit("")) != "ok") for s in MUST_BE_OK), F.lit(0)))
    out = out.withColumn("n_degraded", degraded).withColumn("verdict", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_degraded") > 0, "degraded").otherwise("ok"))
    return out.select("run", "verdict", ((F.col("verdict") == "ok") & (F.coalesce("n_final", F.lit(0)) > 0)).alias("tradable"), "n_failed", "n_degraded")


def theme_map(limit_up: DataFrame, strong: DataFrame, theme: Column) -> DataFrame:
    """code, theme: the theme of the limit-up pool, else that of the strong pool; empty themes don't count."""
    parts = [p.select("code", theme.alias("theme"), F.lit(k).alias("k")).where("theme IS NOT NULL AND theme <> ''") for k, p in enumerate((limit_up, strong))]
    return parts[0].unionByName(parts[1]).groupBy("code").agg(F.min_by("theme", F.struct("k", "theme")).alias("theme"))


def on_demand(codes: DataFrame, spot: DataFrame, rps: DataFrame, inflow: DataFrame) -> DataFrame:
    """Candidates for codes that only signals name: quote, strength and inflow days, each null or 0 where missing; strength says its mode."""
    out = codes.select("code").distinct().join(spot, "code", "left").join(rps.select("code", "rps"), "code", "left").join(inflow.select("code", "inflow_days"), "code", "left")
    return out.withColumn("rps_mode", F.when(F.col("rps").isNotNull(), "real").otherwise("missing")).withColumn("inflow_days", F.coalesce("inflow_days", F.lit(0)))


def approximate_rps(closes: DataFrame, changes: DataFrame) -> DataFrame:
    """code, rps: the share of the day's changes (per cent) that are below the code's 20-row return (a fraction), in per cent; 50 without a return.

    The scales differ, as they do in the rule that this is; it is a fallback only. closes: code, ret20; changes: pct_change. A sorted union, no pairs."""
    both = changes.where("pct_change IS NOT NULL").select(F.lit(None).cast("string").alias("code"), F.col("pct_change").alias("v"), F.lit(1).alias("is_change")).unionByName(closes.where("ret20 IS NOT NULL").select("code", F.col("ret20").alias("v"), F.lit(0).alias("is_change")))
    # counts per distinct value first, so the running sum goes over a table of distinct values
    steps = both.where("is_change = 1").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    asked = both.where("is_change = 0").select("v").distinct().withColumn("n", F.lit(0).cast("long"))
    runs = steps.unionByName(asked).groupBy("v").agg(F.sum("n").alias("n"))
    total = changes.agg(F.count("pct_change").alias("total"))
    below = running_total(runs, [F.col("v").asc()], "n", "below").select("v", "below").crossJoin(F.broadcast(total))
    ranked = closes.join(below, closes["ret20"] == below["v"], "left")
    return ranked.select("code", F.when(F.col("ret20").isNull() | F.coalesce(F.col("total") == 0, F.lit(True)), 50.0).otherwise(ratio(F.col("below"), F.col("total")) * 100).alias("rps"))


def rps_for_codes(codes: DataFrame, rps: DataFrame) -> DataFrame:
    """code, rps, rps_mode of asked codes."""
    found = codes.select("code").distinct().join(rps.select("code", "rps"), "code", "left")
    return found.withColumn("rps_mode", F.when(F.col("rps").isNotNull(), "real").otherwise("missing"))


def inspect(codes: DataFrame, bars: DataFrame, flows: DataFrame, spot: DataFrame, rows: int = 10) -> DataFrame:
    """code, closes and nets (the last rows, oldest first), close, pct_change of asked codes."""
    asked = codes.select("code").distinct()

    def tail(df: DataFrame, value: str, name: str) -> DataFrame:
        last = df.join(F.broadcast(asked), "code", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))).where(F.col("_n") <= rows)
        return last.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("trade_date", value))), lambda x: x[value]).alias(name))

    return asked.join(tail(bars, "close", "closes"), "code", "left").join(tail(flows, "main_net", "nets"), "code", "left").join(spot.select("code", "close", "pct_change"), "code", "left")


def index_deviation(bars: DataFrame) -> DataFrame:
    """code, close, ma20, deviate_pct: the last bar against the mean of the last 20, for indices with 20 rows and more."""
    w = Window.partitionBy("code").orderBy("trade_date")
    f = bars.withColumns({"ma20": F.avg("close").over(w.rowsBetween(-19, 0)), "n": F.count("close").over(w.rowsBetween(-19, 0)), "_back": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))})
    return f.where("_back = 1 AND n = 20").select("code", "close", "ma20", (ratio(F.col("close") - F.col("ma20"), F.col("ma20")) * 100).alias("deviate_pct"))


def board_flow_status(flows: DataFrame, name: str = "board", net: str = "net", size: int = 3) -> DataFrame:
    """inflow_boards, outflow_boards, top_inflow: how many boards take in and lose money, and the first of them."""
    place = F.row_number().over(Window.orderBy(F.desc(net), name))
    ranked = flows.where(F.col(net).isNotNull()).withColumn("_p", place)
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("_p") <= size, F.struct("_p", name)))), lambda x: x[name])
    return ranked.agg(F.count_if(F.col(net) > 0).alias("inflow_boards"), F.count_if(F.col(net) < 0).alias("outflow_boards"), F.array_join(top, ",").alias("top_inflow"))


def ordered_verdicts(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place by falling score, then by the order of verdicts."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, k) for k, v in enumerate(order)], F.lit(len(order)))
    return numbered(df.withColumn("_v", rank), [F.desc("score"), F.col("_v").asc(), F.col("code").asc()]).drop("_v")


def top_of_groups(df: DataFrame, group: str, score: str, sizes: dict[str, int]) -> DataFrame:
    """The best rows of each group, as many as its size says; groups without a size are left out."""
    most = F.coalesce(*[F.when(F.col(group) == k, n) for k, n in sizes.items()])
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "code"))).where(F.col("place") <= most)


def first_rows(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first rows in this order with their place; each task hands on no more than size rows."""
    return df.orderBy(*order).limit(size).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def label_of(score: Column) -> Column:
    """Bullish over 55, bearish under 45."""
    return F.when(score > 55, "bullish").when(score < 45, "bearish").otherwise("neutral")


def narrative(e: DataFrame, size: int = 8) -> DataFrame:
    """The strongest themes with any support: place, theme, label, score, summary. e: theme, support, bull, bear, risk, score."""
    told = first_rows(e.where("support > 0").withColumn("label", label_of(F.col("score"))), [F.desc("score"), F.asc("theme")], size)
    text = F.when(F.col("label") == "bullish", F.format_string("%s driven by good news (%d)", "theme", "bull")).when(F.col("label") == "bearish", F.format_string("%s under bad news or risk (%d / %d)", "theme", "bear", "risk")).otherwise(F.format_string("%s mixed (%d / %d / %d)", "theme", "bull", "bear", "risk"))
    return told.select("place", "theme", "label", F.round("score", 1).alias("score"), text.alias("summary"))


def catalysts(e: DataFrame, candidates: DataFrame, size: int = 15) -> DataFrame:
    """kind, name, support: bullish candidates with news of their own, then bullish themes with two and more items. candidates: code, label, direct, support."""
    own = candidates.where("label = 'bullish' AND direct > 0").select(F.lit("candidate").alias("kind"), F.col("code").alias("name"), "support")
    themes = e.withColumn("label", label_of(F.col("score"))).where("label = 'bullish' AND support >= 2").select(F.lit("theme").alias("kind"), F.col("theme").alias("name"), "support")
    return first_rows(own.unionByName(themes), [F.asc("kind"), F.desc("support"), F.asc("name")], size)


def evolution(daily: DataFrame, key: str, value: str, rows: int = 7) -> DataFrame:
    """key, first, last, n, trend, change: of the last days of each key; trend looks at the last three, change at first and last."""
    w = Window.partitionBy(key).orderBy(F.desc("day"))
    last = daily.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows)
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col(value)))
    g = last.groupBy(key).agg(at(1).alias("v1"), at(2).alias("v2"), at(3).alias("v3"), F.max_by(value, "_n").alias("first"), F.count(F.lit(1)).alias("n"))
    trend = F.when((F.col("v1") > F.col("v2")) & (F.col("v2") > F.col("v3")), "up").when((F.col("v1") < F.col("v2")) & (F.col("v2") < F.col("v3")), "down").otherwise("flat")
    change = F.when((F.col("n") >= 2) & (F.col("v1") > F.col("first")), "up").when((F.col("n") >= 2) & (F.col("v1") < F.col("first")), "down").otherwise("flat")
    return g.select(key, "first", F.col("v1").alias("last"), "n", trend.alias("trend"), change.alias("change"))


def tracked_themes(*sources: DataFrame) -> DataFrame:
    """theme: every theme that hot lists, boards, candidates or signals name. Each source has one column of names."""
    parts = [s.select(F.trim(F.col(s.columns[0]).cast("string")).alias("theme")) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("theme IS NOT NULL AND theme <> ''").distinct()


def dedup_prefix(news: DataFrame, text: str, order: list[str], size: int = 80) -> DataFrame:
    """The first row of each text prefix."""
    w = Window.partitionBy(F.substring(F.coalesce(F.col(text), F.lit("")), 1, size)).orderBy(*order)
    return news.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(manifest: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The last row of a manifest (reports, briefings, calibration runs), by key if there are any."""
    row = F.struct(*[c for c in manifest.columns if c not in (keys or [])])
    g = manifest.groupBy(*(keys or [])).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return g.where("r IS NOT NULL").select(*(keys or []), "r.*")


def calibration_universe(bars: DataFrame, bench: str, skip: int = 10) -> tuple[DataFrame, DataFrame]:
    """trade_date of the benchmark's bars without the last ones (all of them, if there are no more), and the codes of digits."""
    days = bars.where(F.col("code") == bench).select("trade_date").distinct()
    place = days.withColumns({"_n": F.row_number().over(Window.orderBy(F.desc("trade_date"))), "_all": F.count(F.lit(1)).over(Window.partitionBy())})
    return place.where((F.col("_n") > skip) | (F.col("_all") <= skip)).select("trade_date"), bars.select(F.trim("code").alias("code")).distinct().where(F.col("code").rlike("^[0-9]+$"))


def collect_factors(candidates: DataFrame, market: dict[str, DataFrame], per_code: dict[str, DataFrame], budget: int | None = None) -> DataFrame:
    """Candidates with the factors of one-row market tables and of tables by code; with a budget, only the first candidates by score get the latter, and in_budget says which."""
    out = candidates
    for table in market.values():
        out = out.crossJoin(F.broadcast(table.limit(1)))
    if budget is not None:
        first = candidates.orderBy(F.desc("score"), "code").limit(budget).select("code", F.lit(True).alias("in_budget"))
        out = out.join(F.broadcast(first), "code", "left").withColumn("in_budget", F.coalesce("in_budget", F.lit(False)))
    for name, table in per_code.items():
        t = table.withColumn("_has", F.lit(True)).select("code", F.struct(*[c for c in table.columns if c != "code"]).alias(name))
        out = out.join(t, "code", "left")
        if budget is not None:
            out = out.withColumn(name, F.when(F.col("in_budget"), F.col(name)))
    return out


#: How values are written in stored pages, and the type that each is read as.
VALUES = {"number": (r"(\d+(?:\.\d+)?)", "double"), "count": (r"(\d+)", "int"), "word": (r"(\p{IsHan}+)", "string"), "day": (r"(\d{4}-\d\d-\d\d)", "string")}
#: What stored pages say about a stock: fact, label before it, words between label and value, kind of value, words after it.
FACTS = (
    ("eps_consensus", "一致预期每股收益", "", "number", ""), ("rating", "综合评级", "", "word", ""), ("analyst_count", "", "", "count", "位分析师"), ("dividend_per_share", "每股派息", "", "number", "元"),
    ("ex_date", "除权除息日", "", "day", ""), ("bonus_ratio", "送股", "每10股送", "number", "股"), ("transfer_ratio", "转增", "每10股转增", "number", "股"),
)
#: What may stand between the parts of a fact.
BETWEEN = r"(?:[：:\s]|&nbsp;|<[^>]{0,200}>)*"


def fact_pattern(label: str, lead: str, kind: str, unit: str) -> str:
    return BETWEEN.join(part for part in (label, lead, VALUES[kind][0], unit) if part)


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The facts of each page; null where the page doesn't say. Labels and values may be in elements of their own."""
    text = F.coalesce(F.col(html), F.lit(""))
    return pages.withColumns({name: F.nullif(F.regexp_extract(text, fact_pattern(label, lead, kind, unit), 1), F.lit("")).try_cast(VALUES[kind][1]) for name, label, lead, kind, unit in FACTS})


def factor_notes() -> tuple[Column, Column]:
    """reasons and risks of structured factors, four at most each, from the columns of rules.structured."""
    some = lambda *tests: F.slice(F.filter(F.array(*[F.when(t, w) for t, w in tests]), lambda x: x.isNotNull()), 1, 4)
    c = F.col
    return some((c("lhb_net_wan") > 0, "dragon-tiger net buying"), (c("hot_rank") != 0, "hot list"), (c("flow20") > 0, "20-day inflow"), (c("north5") > 0, "northbound buying")), some((c("flow20") < 0, "20-day outflow"), (c("north5") < 0, "northbound selling"), (c("n_ann_risks") > 0, "risk announcement"))


def executed(trades: DataFrame) -> DataFrame:
    """Sells with whether the stop or the target was what they met. trades: price, stop, target."""
    return trades.withColumns({"hit_stop": F.coalesce((F.col("stop") > 0) & (F.col("price") <= F.col("stop")), F.lit(False)), "hit_target": F.coalesce((F.col("target") > 0) & (F.col("price") >= F.col("target")), F.lit(False))})


def point_in_time(bars: DataFrame, first: str, last: str, step: str = "INTERVAL 1 MONTH") -> DataFrame:
    """day and each code's last bar up to it, for the days from first to last: what was known then. Days are few and go to each bar's own span; bars don't meet other bars."""
    marks = bars.withColumn("_until", F.lead("trade_date").over(Window.partitionBy("code").orderBy("trade_date")))
    days = F.expr(f"sequence(DATE '{first}', DATE '{last}', {step})")
    own = F.filter(days, lambda x: (x >= F.col("trade_date")) & (F.col("_until").isNull() | (x < F.col("_until"))))
    return marks.withColumn("day", F.explode(own)).drop("_until")


def board_view(spot: DataFrame, stocks: DataFrame, *keys: str) -> DataFrame:
    """Boards rebuilt from the bars of their stocks: n, up, mean change, amount; by keys and board."""
    g = spot.join(stocks.select("code", "board"), "code").groupBy(*keys, "board")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pct_change") > 0).alias("up"), F.avg("pct_change").alias("mean_pct"), F.sum("amount").alias("amount"))


def tag_strength(spot: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, n, up, mean_pct, amount, place: stocks counted under each of their tags. tags: code, tags array; a tag counts once a stock."""
    long = spot.join(tags.select("code", F.explode(F.array_distinct("tags")).alias("tag")), "code")
    g = long.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pct_change") > 0).alias("up"), F.avg("pct_change").alias("mean_pct"), F.sum("amount").alias("amount"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_pct"), "tag")))


def posture(temperature: Column) -> Column:
    """Cold under 40, hot over 85, else normal; null without a temperature."""
    return F.when(temperature < 40, "cold").when(temperature > 85, "hot").when(temperature.isNotNull(), "normal")


def broke_share(broken: Column, held: Column) -> Column:
    """Broken seals of all seals, per cent: sum of broken over held and broken; null where nobody counted."""
    return ratio(F.sum(broken), F.count(held) + F.sum(broken)) * 100
