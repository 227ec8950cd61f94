"""Text measures over news: lexicons, risk sentences, entities, themes, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.scalars import content_hash, ratio, word_hits


def lexicon(docs: DataFrame, positive: list[str], negative: list[str], risk: list[str]) -> DataFrame:
    """Distinct word hits, score 0..100, label (0.15 either side of even) and class; null text has no hits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"pos": word_hits(text, positive), "neg": word_hits(text, negative), "risks": word_hits(text, risk)})
    raw = F.coalesce(ratio((F.col("pos") - F.col("neg")).cast("double"), F.col("pos") + F.col("neg")), F.lit(0.0))
    d = d.withColumn("raw", raw).withColumn("score", (F.col("raw") + 1) * 50)
    return d.withColumn("label", F.when(F.col("raw") > 0.15, "positive").when(F.col("raw") < -0.15, "negative").otherwise("neutral")).withColumn("kind", F.concat(F.when(F.col("pos") > F.col("neg"), "bullish").when(F.col("neg") > F.col("pos"), "bearish").otherwise("neutral"), F.when(F.col("risks") > 0, "+risk").otherwise("")))


def sentiment_level(d: DataFrame) -> DataFrame:
    """Five levels by the share of positive hits, confidence by the number of hits."""
    hits = F.col("pos") + F.col("neg")
    share = ratio(F.col("pos").cast("double"), hits)
    level = F.when(hits == 0, "neutral").when(share >= 0.8, "very_positive").when(share >= 0.6, "positive").when(share > 0.4, "neutral").when(share > 0.2, "negative").otherwise("very_negative")
    return d.withColumn("level", level).withColumn("confidence", F.least(F.lit(0.85), 0.5 + 0.05 * hits))


def sentiment_index(d: DataFrame, key: str) -> DataFrame:
    """(positive - negative) / n * 100 by key."""
    good, bad = F.col("level").isin("positive", "very_positive"), F.col("level").isin("negative", "very_negative")
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("positive"), F.count_if(bad).alias("negative"), (ratio((F.count_if(good) - F.count_if(bad)).cast("double"), F.count(F.lit(1))) * 100).alias("index"), F.avg("confidence").alias("confidence"))


def risk_sentences(docs: DataFrame, risk: list[str], most: int = 10) -> DataFrame:
    """The first distinct sentences of each text that hold a risk word."""
    parts = F.filter(F.transform(F.split(F.col("text"), "[。.\n]"), lambda s: F.trim(s)), lambda s: word_hits(s, risk) > 0)
    return docs.select("doc_id", F.slice(F.array_distinct(parts), 1, most).alias("found")).select("doc_id", F.posexplode("found").alias("place", "sentence"))


def entities(docs: DataFrame) -> DataFrame:
    """Six-digit codes and amounts with their units."""
    return docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\b\d{6}\b"), 0).alias("codes"), F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)\s*(亿元|万元|亿|万|%)"), 0).alias("amounts"))


def dedup(docs: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each content hash."""
    w = Window.partitionBy("content_hash").orderBy(*order)
    return docs.withColumn("content_hash", content_hash(F.col("text"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def theme_hits(docs: DataFrame, themes: list[str]) -> DataFrame:
    """A row for each text and theme that it names."""
    named = F.filter(F.array(*[F.lit(t) for t in themes]), lambda t: F.contains(F.col("text"), t))
    return docs.withColumn("theme", F.explode(named))


def hot_themes(docs: DataFrame, themes: list[str], size: int = 15) -> DataFrame:
    return theme_hits(docs, themes).groupBy("theme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "theme").limit(size)


def theme_evidence(d: DataFrame, themes: list[str]) -> DataFrame:
    """Support, bullish, bearish and risk counts by theme, and a score: 50 + (bull - bear - 1.5 risk) / total * 50, within 0..100."""
    g = theme_hits(d, themes).groupBy("theme").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("kind").startswith("bullish")).alias("bull"), F.count_if(F.col("kind").startswith("bearish")).alias("bear"), F.count_if(F.col("risks") > 0).alias("risk"))
    total = F.greatest(F.col("bull") + F.col("bear") + F.col("risk"), F.lit(1))
    return g.withColumn("score", F.least(F.greatest(50 + (F.col("bull") - F.col("bear") - 1.5 * F.col("risk")).cast("double") / total * 50, F.lit(0.0)), F.lit(100.0)))
