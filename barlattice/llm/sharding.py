"""Sharding by extendible hashing, in DataFrame operations only.

Every row has a 60-bit hash. The directory is indexed by the first bits of it; a bucket is a hash prefix. A
bucket over the byte limit splits on one more bit, others stay, so a shard is the shortest prefix whose rows
fit. Instead of splitting one bucket at a time, the bytes of the slots of a directory deep enough for most are summed
once; slots over the limit that hold several hashes, and only they, are summed again by more bits, until every slot fits or
holds a single hash. The slots' bytes are rolled up to all shorter prefixes; each slot then takes its shortest prefix that fits.

The hash covers doc_id and text, so a repeated or null doc_id does not force different texts into one bucket.

Defined results: null text has 0 bytes; rows equal in doc_id and text share a hash and so a shard; a shard is
over the limit only where its rows all share one hash (one document larger than the limit, or equal rows), and
`oversized` says so. An empty table has no shards. If all rows fit in one shard, its id is the empty prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import free_name, materialise

HASH_BITS = 60
#: Slots of at most so many rows (some 100 bytes each in a hash table) are broadcast; more are joined by a shuffle, whatever their files' size.
BROADCAST_SLOTS = 20_000


def row_hash(id_col: Column, text_col: Column) -> Column:
    """The first 60 bits of the MD5 of doc_id and text, as a long."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text_col, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


#: By how many bits a crowded slot is split at once.
STEP = 4


def slot_of(bits: int) -> Column:
    return F.expr(f"h >> {HASH_BITS - bits}")


def few_or_not(slots: DataFrame) -> DataFrame:
    """The slots, to be broadcast if they are few; a size guessed from packed files must not send more of them to the driver."""
    return F.broadcast(slots) if slots.count() <= BROADCAST_SLOTS else slots.hint("merge")


def directory(keys: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """Slots of the directory: bits, slot, depth, prefix, shard_bytes, shard_docs; and the numbers of bits that slots have. Every hash is in exactly one slot. keys: h, doc_bytes."""
    total = keys.agg(F.sum("doc_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    rows, levels, settled = keys, [], None
    while True:
        levels.append(bits)
        slots = rows.groupBy(slot_of(bits).alias("slot")).agg(F.sum("doc_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        slots = materialise(slots.select(F.lit(bits).alias("bits"), "*", ((F.col("b") > limit) & (F.col("lo") < F.col("hi")) & F.lit(bits < HASH_BITS)).alias("crowded")), "slots")
        done = slots.where("NOT crowded")
        settled = done if settled is None else settled.union(done)
        crowded = slots.where("crowded").select("slot")
        if crowded.isEmpty():
            break
        rows = rows.withColumn("slot", slot_of(bits)).join(few_or_not(crowded), "slot", "left_semi").drop("slot")
        bits = min(HASH_BITS, bits + STEP)
    up = settled.select("*", F.explode(F.sequence(F.lit(0), F.col("bits"))).alias("depth")).withColumn("prefix", F.expr("shiftright(slot, bits - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
    # a row per slot and depth on one side, per prefix on the other: both grow with the input and are guessed too small from the slots' files
    best = up.select("bits", "slot", "depth", "prefix").join(fits.select("depth", "prefix", "shard_bytes", "shard_docs").hint("merge"), ["depth", "prefix"])
    best = best.groupBy("bits", "slot").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("leaf")).select("bits", "slot", "leaf.*")
    return materialise(best, "directory"), levels


def located(rows: DataFrame, hashed: str, slots: DataFrame, levels: list[int]) -> DataFrame:
    """rows with the columns of their slots; a row asks for its slot at each number of bits, and one is there."""
    asked = F.array(*[F.struct(F.lit(bits).alias("bits"), F.expr(f"`{hashed}` >> {HASH_BITS - bits}").alias("slot")) for bits in levels])
    own = free_name(rows, "x_slot")
    there = few_or_not(slots.withColumn(own, F.struct("bits", "slot")).drop("bits", "slot"))
    return rows.withColumn(own, F.explode(asked)).join(there, own).drop(own)


def assign_shards(docs: DataFrame, limit: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, doc_bytes, shard_id (prefix bits), shard_depth, shard_bytes, shard_docs, oversized."""
    keys = docs.select(F.col(id_col).alias("doc_id"), row_hash(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("doc_bytes"))
    keys = materialise(keys, "keys")
    out = located(keys, "h", *directory(keys, limit))
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), HASH_BITS, "0").substr(F.lit(HASH_BITS + 1) - F.col("depth"), F.col("depth")))
    return out.select("doc_id", "doc_bytes", shard.alias("shard_id"), F.col("depth").alias("shard_depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as one Parquet folder per shard (shard=<prefix bits>); a shard is written by one task, within its byte limit."""
    hash_col, shard_col = free_name(docs, "x_hash"), free_name(docs, "shard")
    keys = docs.withColumn(hash_col, row_hash(F.col(id_col), F.col(text_col)))
    sized = materialise(keys.select(F.col(hash_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("doc_bytes")), "keys")
    slots, levels = directory(sized, limit)
    shard = F.when(F.col("depth") == 0, F.lit("all")).otherwise(F.lpad(F.bin("prefix"), HASH_BITS, "0").substr(F.lit(HASH_BITS + 1) - F.col("depth"), F.col("depth")))
    placed = located(keys, hash_col, slots.select("bits", "slot", shard.alias(shard_col)), levels)
    placed.select(*docs.columns, shard_col).repartition(shard_col).write.partitionBy(shard_col).parquet(path)
