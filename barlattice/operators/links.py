"""Links between tables: boards and members, news and stocks, buckets and prices; and text that becomes columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import first_true, number, word_hits
from barlattice.operators.needles import find

#: Separators of theme lists, in order, and words for no theme.
SEPARATORS = ["+", "、", ",", "，", ";", "；", "/", "|"]
NO_THEME = ["", "nan", "none", "null", "-"]


def theme(x: Column) -> Column:
    """The part before the first separator, in the list's order, that the text has; 18 characters at most; '' for no theme."""
    t = F.trim(F.coalesce(x, F.lit("")))
    cut = first_true(*[(t.contains(s), F.substring_index(t, s, 1)) for s in SEPARATORS], default=t)
    return F.when(F.lower(t).isin(NO_THEME), "").otherwise(F.substring(F.trim(cut), 1, 18))


def industry(name: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule with a keyword in the name."""
    return first_true(*[(word_hits(name, words) > 0, label) for label, words in rules], default="other")


def bin_bounds(bins: dict[str, list[tuple[float | None, str]]]) -> list[tuple[str, str, float | None, float | None]]:
    """feature, label, low, high of every bin; a lookup instead of parsing labels."""
    out = []
    for feature, parts in bins.items():
        low: float | None = None
        for high, label in parts:
            out.append((feature, label, low, high))
            low = high
    return out


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double columns to null, for JSON."""
    bad = [float("inf"), float("-inf")]
    return df.withColumns({c: F.when(~F.isnan(c) & ~F.col(c).isin(bad), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def verdict_json(x: Column) -> Column:
    """verdict, confidence of a reply: parsed as JSON, else by pattern."""
    parsed = F.from_json(F.regexp_extract(x, r"(\{[\s\S]*\})", 1), "verdict string, confidence double", {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})
    loose = F.nullif(F.regexp_extract(x, r"verdict\W+(\w+)", 1), F.lit(""))
    sure = number(F.nullif(F.regexp_extract(x, r"confidence\W+([0-9.]+)", 1), F.lit("")))
    return F.struct(F.coalesce(parsed["verdict"], loose).alias("verdict"), F.coalesce(parsed["confidence"], sure).alias("confidence"))


def last_board(members: DataFrame) -> DataFrame:
    """code, board of the last of a code's boards in order. members: code, board, place."""
    return members.groupBy("code").agg(F.max_by("board", F.struct("place", "board")).alias("board"))


def fuzzy_boards(stocks: DataFrame, boards: DataFrame, unmatched: bool = False) -> DataFrame:
    """code, matched: the exact board, else the first (by name) that holds the stock's board's name or is held by it; with unmatched, stocks without any have null.

    boards is a list of some hundreds of names at any scale, so the nested-loop join broadcasts it; equal names are matched by key first.
    """
    b = boards.select(F.col("board").alias("matched")).distinct()
    distinct = stocks.select("board").distinct()
    met = distinct.join(F.broadcast(b), F.contains("board", "matched") | F.contains("matched", "board"))
    best = met.groupBy("board").agg(F.min(F.struct((F.col("board") != F.col("matched")).alias("far"), "matched")).alias("x")).select("board", "x.matched")
    return stocks.join(best, "board", "left" if unmatched else "inner").select("code", "board", "matched")


def news_links(news: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, code of texts that hold a stock's code or name; empty names say nothing."""
    return find(news, names.select("code", F.explode(F.array("code", "name")).alias("needle")))


def inherited(direct: DataFrame, themes: DataFrame, evidence: DataFrame) -> DataFrame:
    """code, kind, score: direct evidence, else that of the stock's themes, which counts as neutral. direct: code, score; themes: code, theme; evidence: theme, score."""
    by_theme = themes.join(evidence, "theme").groupBy("code").agg(F.avg("score").alias("theme_score"))
    both = direct.groupBy("code").agg(F.avg("score").alias("score")).join(by_theme, "code", "full")
    return both.select("code", F.when(F.col("score").isNotNull(), "direct").otherwise("inherited").alias("kind"), F.coalesce("score", F.lit(50.0)).alias("score"))


def fused_score(flash: DataFrame, stock: DataFrame) -> DataFrame:
    """code, score: the mean of both scores, or the one there is."""
    f, s = flash.select("code", F.col("score").alias("a")), stock.select("code", F.col("score").alias("b"))
    return f.join(s, "code", "full").select("code", F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b").alias("score"))


def price_fallback(holdings: DataFrame, spot: DataFrame, trades: DataFrame) -> DataFrame:
    """holdings with a price: the snapshot's, else the last trade's, else the average cost; and which it is."""
    last = trades.groupBy("code").agg(F.max_by("price", "seq").alias("traded"))
    out = holdings.join(spot.select("code", F.col("close").alias("quoted")), "code", "left").join(last, "code", "left")
    return out.withColumn("price", F.coalesce("quoted", "traded", "cost")).withColumn("price_source", F.when(F.col("quoted").isNotNull(), "spot").when(F.col("traded").isNotNull(), "trade").otherwise("cost")).drop("quoted", "traded")


def status_rollup(states: DataFrame) -> DataFrame:
    """group, status: failed if a critical source failed, degraded if any isn't ok. states: group, source, critical, status."""
    return states.groupBy("group").agg(F.when(F.max(F.col("critical") & (F.col("status") == "failed")), "failed").when(F.max(F.col("status") != "ok"), "degraded").otherwise("ok").alias("status"))


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the non-empty values of over."""
    o = over.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(o, key, "left").withColumns({c: F.coalesce(F.nullif(F.col(f"_{c}").cast("string"), F.lit("")).cast(base.schema[c].dataType), F.col(c)) for c in columns})
    return out.drop(*[f"_{c}" for c in columns])


def short_line(p: DataFrame, leaders: int = 8) -> DataFrame:
    """Per day of the limit-up pool: highest streak, how many with two and more, how many at one price all day, the first codes by streak."""
    one = F.abs(F.col("open") / F.col("close") - 1) <= 0.001
    ranked = p.where("is_up").withColumn("_k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("streak"), "code")))
    first = F.sort_array(F.collect_list(F.when(F.col("_k") <= leaders, F.struct("_k", "code"))))  # nulls are not collected
    g = ranked.groupBy("trade_date").agg(F.max("streak").alias("highest"), F.count_if(F.col("streak") >= 2).alias("ladder"), F.count_if(one & (F.col("low") >= F.col("close") * 0.999)).alias("one_price"), first.alias("codes"))
    return g.withColumn("leaders", F.transform("codes", lambda x: x["code"])).drop("codes")


def technical_snapshot(f: DataFrame) -> DataFrame:
    """The last bar of each code with 35 rows or more: averages, volume ratio, state, and the last 60 bars. Only those 60 bars are collected, in the order that the features are in."""
    order = Window.partitionBy("code").orderBy("trade_date")
    near = f.withColumn("_later", F.lead(F.lit(1), 60).over(order)).where("_later IS NULL").drop("_later")
    bars = near.withColumn("last60", F.collect_list(F.struct("trade_date", "open", "high", "low", "close", "volume")).over(order.rowsBetween(-59, 0))).withColumn("_next", F.lead(F.lit(1)).over(order))
    return bars.where("_next IS NULL AND rn >= 35").drop("_next")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, heading, body, codes: the parts of Markdown briefings by heading, with the six-digit codes of each (Arrow batches; a section is within one text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                heading, body = "", []
                for line in [*(text or "").split("\n"), "## "]:
                    if re.match(r"#{2,3} ", line):
                        if heading or any(x.strip() for x in body):
                            joined = "\n".join(body).strip()
                            rows.append((doc, heading, joined, list(dict.fromkeys(re.findall(r"(?<![\d.])([036]\d{5})(?![\d.])", joined)))))
                        heading, body = line.lstrip("# ").strip(), []
                    else:
                        body.append(line)
            yield pd.DataFrame(rows, columns=["doc_id", "heading", "body", "codes"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, heading string, body string, codes array<string>")
