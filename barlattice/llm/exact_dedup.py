"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

1. One pass turns every text into the SHA-256 of its normalised form (A-Z lower-cased; null counts as empty).
2. A Misra-Gries summary of bounded size (the frequent-items sketch behind approx_top_k, merged from partial
   sketches) proposes the digests that may be frequent.
3. Their exact group sizes and winners are counted with map-side partial sums ("verified"), and broadcast:
   at most `heavy_items` rows, whatever the input.
4. Map-side, copies that lose against a broadcast winner need no shuffle; only winners and the remaining
   digests are shuffled, and these are counted in parts before: a group goes through no single task whole.

Defined results: null text is the empty text; the row with the largest doc_id stays, a null doc_id counts as
the smallest; rows that repeat both doc_id and text all count in group_size, and in `drop_copies` exactly one
of them stays. An empty table gives an empty result. Extra columns pass through `drop_copies` untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import free_name, materialise


#: Tables of at most so many rows (about 100 bytes each) are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def frequent_digests(digests: DataFrame, heavy_items: int, tracked: int) -> list[str]:
    """Digests that may be frequent; at most heavy_items strings reach the driver."""
    found = digests.agg(F.expr(f"approx_top_k(digest, {heavy_items}, {tracked})").alias("top")).first()["top"]
    return [x["item"] for x in found or [] if x["count"] >= 2]


def verified_winners(digests: DataFrame, heavy_items: int, tracked: int) -> DataFrame:
    """digest, w_keep, w_size of the frequent digests, counted exactly; at most heavy_items rows."""
    spark = digests.sparkSession
    named = spark.createDataFrame([(x,) for x in frequent_digests(digests, heavy_items, tracked)], "digest string")
    return digests.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("w_keep"), F.count(F.lit(1)).alias("w_size"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_items: int = 256, tracked: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "digests")
    winners = materialise(verified_winners(digests, heavy_items, tracked).coalesce(1), "winners")
    joined = digests.join(F.broadcast(winners), "digest", "left")
    loses = F.col("w_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("w_keep"))
    lost = joined.where(loses).select("doc_id", F.col("w_keep").alias("keep_id"), F.col("w_size").alias("group_size"), "digest")
    left = joined.where(~loses)
    # sizes and winners of the other digests: partial counts before the shuffle, then joined back
    groups = left.where("w_size IS NULL").groupBy("digest").agg(F.max("doc_id").alias("g_keep"), F.count(F.lit(1)).alias("g_size"))
    rest = left.join(groups, "digest", "left").select("doc_id", F.when(F.col("w_size").isNotNull(), F.col("w_keep")).otherwise(F.col("g_keep")).alias("keep_id"), F.coalesce("w_size", "g_size").alias("group_size"), "digest")
    return lost.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_items: int = 256, tracked: int = 4096) -> DataFrame:
    """The rows of docs, all columns, without those whose text a row with a larger doc_id has.

    What is decided is decided on ids and digests; rows with their texts move only if the losers are too many to broadcast, or for rows that repeat both id and text."""
    marks = materialise(mark_copies(docs, id_col, text_col, heavy_items, tracked).select("doc_id", "kept", "group_size", "text_sha256"), "marks")
    digest, other, rank = (free_name(docs, x) for x in ("x_digest", "x_id", "x_rank"))
    pair = [F.col("doc_id").alias(other), F.col("text_sha256").alias(digest)]
    lost = materialise(marks.where(~F.col("kept")).select(*pair).distinct(), "losers")
    twice = materialise(marks.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair), "repeated")
    met = F.col(id_col).eqNullSafe(F.col(other)) & (digest_of(F.col(text_col)) == F.col(digest))
    left = docs.join(few_or_not(lost), met, "left_anti")
    if twice.isEmpty():
        return left
    order = Window.partitionBy(F.col(id_col), digest_of(F.col(text_col))).orderBy(F.lit(1))
    once = left.join(few_or_not(twice), met, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
    return left.join(few_or_not(twice), met, "left_anti").unionByName(once)


def few_or_not(rows: DataFrame) -> DataFrame:
    """Rows of an id and a digest, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
