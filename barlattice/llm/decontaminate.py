"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A text is the sequence of its lower-cased words (runs of letters and digits). A document is contaminated by a
benchmark item if, on some alignment of the two, a window of WINDOW words of the item (all its words, if it has
fewer) has at least 80 % of its words in place in the document: substituted words are tolerated, at any position.

Seeds are fixed masks of word positions; positions outside the mask are ignored. Hashes of the masked words at every
position of the items are joined with those of every position of the documents; each hit names an alignment (document,
item, offset), and each distinct alignment is verified word by word on the texts themselves. Every window that
qualifies has a seed without a substituted word in it (`lossless` tries all ways to place the substitutions), so the
seeds lose nothing: one spaced seed of weight five does for full windows; two lighter ones serve items of fewer words,
and are looked up only where the benchmark has such items.

Scale: the documents are not shuffled; the seeds of the items are broadcast if they are few (their number is checked),
else both sides are shuffled. What is shuffled is hits. Alignments are verified in one pass per document; where they
are too many to broadcast, the ids of the documents that have any are (up to BROADCAST_DOCS), and only these
documents are shuffled. Beyond that number documents are shuffled once.

Defined results: null and empty texts have no words and match nothing; items of fewer than four words never match, of
four or five only as a whole; rows that share a doc_id are one document in the result; other columns are ignored, and
pass through `drop_contaminated`. Empty tables give an empty result.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import free_name, materialise

WINDOW = 13
SHARE = 0.8
#: The word positions that seeds look at, in full windows and in items of fewer words.
MASKS = ((0, 1, 3, 6, 7),)
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
SHORTEST = 4
#: Tables of at most so many rows (under 100 bytes each) are broadcast; beyond, joins shuffle. Ids take 16 bytes.
BROADCAST_SEEDS = 500_000
BROADCAST_HITS = 200_000
BROADCAST_DOCS = 1_000_000
#: Ways to place substitutions that `lossless` tries at most; beyond, a window counts as not proven and takes the lighter seeds.
TRIED = 100_000


def needed(words: int, share: float = SHARE) -> int:
    """How many words of a window of so many must be in place."""
    return words if words < 6 else math.ceil(share * words - 1e-9)


def lossless(masks: tuple, words: int, share: float = SHARE) -> bool:
    """Whether some placed seed of the masks avoids the substitutions, wherever a qualifying window of so many words has them."""
    wrong = words - needed(words, share)
    if math.comb(words, wrong) > TRIED:
        return False
    placed = [{o + at for o in mask} for mask in masks for at in range(words - mask[-1])]
    return all(any(seed.isdisjoint(odd) for seed in placed) for odd in itertools.combinations(range(words), wrong))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masked(h: Column, mask: tuple[int, ...]):
    return lambda i: F.xxhash64(F.lit(str(mask)), *[h[i + o] for o in mask])


def seed_hashes(h: Column, masks: tuple) -> Column:
    """The seeds of a text: for each mask in turn, one hash per position. h: hashes of the words."""
    parts = []
    for mask in masks:
        last = F.size(h) - mask[-1] - 1
        parts.append(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), masked(h, mask))).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts)


def seeds_of(texts: DataFrame, key: str, masks: tuple) -> DataFrame:
    """key, pos, seed for every masked position of every text. texts: key, text."""
    hashed = texts.select(key, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    wide = hashed.select(key, F.size("h").alias("n"), seed_hashes(F.col("h"), masks).alias("seeds"))
    # the outer form, because the plain one puts a filter below that evaluates the whole expression once more for every word
    flat = wide.select(key, "n", F.posexplode_outer("seeds").alias("p", "seed")).where("p is not null")
    pos, before = F.col("p"), F.lit(0)
    place = F.lit(None).cast("int")
    for mask in reversed(masks):
        start = sum((F.greatest(F.col("n") - m[-1], F.lit(0)) for m in masks[: masks.index(mask)]), before)
        place = F.when(pos >= start, F.coalesce(place, pos - start)).otherwise(place)
    return flat.select(key, place.alias("pos"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """A row per contaminated document and item: doc_id, item_id, item_words, window_words, n_matched (most words in place in a window), doc_word (where the item's first word falls, on the first such alignment)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    size = F.size(words_of(F.col("text")))
    masks = MASKS if lossless(MASKS, window, share) else SHORT_MASKS
    fewer = items.where(size < window)
    probes = seeds_of(items.where(size >= window), "item_id", masks)
    if masks != SHORT_MASKS and not fewer.isEmpty():
        probes, masks = probes.union(seeds_of(fewer, "item_id", SHORT_MASKS)), masks + SHORT_MASKS
    elif masks == SHORT_MASKS:
        probes = seeds_of(items, "item_id", masks)
    probes = materialise(probes.withColumnRenamed("pos", "item_pos"), "seeds")
    few = probes.count() <= BROADCAST_SEEDS
    hits = seeds_of(texts, "doc_id", masks).join(F.broadcast(probes) if few else probes, "seed")
    lines = materialise(hits.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "alignments")
    want = lines.select(F.col("doc_id").alias("hit_doc"), F.col("item_id").alias("hit_item"), "shift")
    if lines.count() <= BROADCAST_HITS:
        want = F.broadcast(want)
    else:
        met_ids = materialise(lines.select(F.col("doc_id").alias("met_doc")).distinct(), "met")
        if met_ids.count() <= BROADCAST_DOCS:
            texts = texts.join(F.broadcast(met_ids), F.col("doc_id").eqNullSafe(F.col("met_doc")), "left_semi")
    itemised = items.select("item_id", words_of(F.col("text")).alias("item"))
    met = texts.select("doc_id", words_of(F.col("text")).alias("doc")).join(want, F.col("doc_id").eqNullSafe(F.col("hit_doc")))
    met = met.join(F.broadcast(itemised) if few else itemised, F.col("hit_item").eqNullSafe(F.col("item_id")))
    same = F.transform(F.col("item"), lambda w, i: F.when(F.get("doc", F.col("shift") + i) == w, 1).otherwise(0))
    size = F.least(F.size("item"), F.lit(window))
    met = met.select("doc_id", "item_id", "shift", F.size("item").alias("item_words"), size.alias("window_words"), same.alias("same"))
    sums = F.transform(F.sequence(F.lit(1), F.col("item_words") - F.col("window_words") + 1), lambda a: F.aggregate(F.slice("same", a, F.col("window_words")), F.lit(0), lambda s, x: s + x))
    met = met.withColumn("n_matched", F.array_max(sums))
    least = F.when(F.col("window_words") < 6, F.col("window_words")).otherwise(F.ceil(F.col("window_words") * share - 1e-9))
    met = met.where(F.col("n_matched") >= least)
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", (-F.col("shift")).alias("back"), "item_words", "window_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.item_words", "best.window_words", "best.n_matched", (-F.col("best.back")).alias("doc_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that no benchmark item overlaps."""
    name = free_name(docs, "x_bad")
    bad = materialise(overlaps(docs, benchmark, id_col, text_col, **how).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    small = bad.count() <= BROADCAST_SEEDS
    return docs.join(F.broadcast(bad) if small else bad, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
