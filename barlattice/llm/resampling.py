"""Importance resampling towards a target distribution, over hashed n-grams.

1. Per piece of some MB of text, words become word ids (an exact dictionary), and the ids of all texts one suffix
   array, sorted to the depth of the longest n-gram. Neighbours in it that agree on their first n words form a run
   (`runs`): one distinct n-gram of the piece. Each run is hashed once, and its bucket goes back to all of its places.
   So each document has the buckets of its features, which are written once and read by both steps below.
2. Buckets are counted over all documents and over all texts of the target: partial sums per task, then a row per
   bucket. What a feature of a bucket gains is the logarithm of its smoothed share in the target over that in the documents.
3. A document's weight is its features' mean gain. With Gumbel noise on it, drawn from the document's id, the highest
   scores are a sample without replacement in proportion to the weights. Places come from `ranking.numbered`: no task
   sees all documents.

What is broadcast are the gains, one number per bucket. Words are runs of ASCII letters and digits and of all characters
beyond ASCII; only A-Z are lower-cased.

Defined results: null and empty texts, and texts without words, have no features: weight 0, score of the noise alone.
Repeated rows have equal scores and places next to each other; a null id counts as the empty text in the noise and is the
smallest of ties. An empty table gives an empty result; without any target text every t and T is 0. Other columns are ignored by
`importance` and kept by `resample`. Ids are cast to long. Very long texts are a piece of their own, taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, free_name, materialise, small_batches
from barlattice.operators.ranking import numbered

by_value(__name__)

BUCKETS = 10_000
MAX_WORDS = 2
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text that share a suffix array.
SHARED = 4 << 20

#: The bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts, the id of every word in order, and the bounds of each text's words."""
    start, end, of = tc.words(data, offsets, WORD)
    if not len(start):
        return [], start, np.zeros(len(offsets), dtype=np.int64)
    cuts = np.stack([start, end], axis=1).ravel()
    parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    known = parts.take(pa.array(np.arange(0, len(cuts), 2))).dictionary_encode()
    return known.dictionary.to_pylist(), known.indices.to_numpy().astype(np.int64), np.searchsorted(of, np.arange(len(offsets)))


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the words from there on, as far as depth; a text that ends sorts first. left: words left in the text, from each place on. By doubling."""
    rank, done = ids + 1, 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        beyond = np.zeros_like(rank)
        more = np.flatnonzero(left > done)
        beyond[more] = rank[more + done]
        order = np.lexsort((beyond, rank))
        new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (beyond[order][1:] != beyond[order][:-1])]) if len(order) else np.zeros(0, dtype=bool)
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        done *= 2
    return order


def runs(ids: np.ndarray, left: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 to most: n, the places that have n words, in suffix order, and where each run of equal n-grams begins among them."""
    order = suffix_array(ids, left, most)
    for n in range(1, most + 1):
        # lcp with the neighbour before, as far as n words: the places short of n words are no members of any run
        at = order[left[order] >= n]
        apart = np.zeros(max(0, len(at) - 1), dtype=bool)
        for k in range(n):
            apart |= ids[at[1:] + k] != ids[at[:-1] + k]
        yield n, at, np.flatnonzero(np.concatenate([[True], apart])) if len(at) else at


def buckets_of(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket of each feature of each text, and the number of words of each text."""
    words, ids, at = word_ids(tc.LOWER[data], offsets)
    count = np.diff(at)
    left = np.repeat(at[1:], count) - np.arange(len(ids))
    parts = [[] for _ in count]
    for n, places, heads in runs(ids, left, most):
        joined = (b" ".join([words[k] for k in ids[p : p + n]]) for p in places[heads]) if n > 1 else (words[k] for k in ids[places[heads]])
        hashed = np.fromiter((zlib.crc32(x) % buckets for x in joined), dtype=np.int64, count=len(heads))
        mine = np.full(len(ids), -1, dtype=np.int64)
        mine[places] = np.repeat(hashed, np.diff(np.append(heads, len(places))))
        for d in np.flatnonzero(count >= n):
            parts[d].append(mine[at[d] : at[d + 1] - n + 1])
    none = np.zeros(0, dtype=np.int64)
    return [np.concatenate(p) if p else none for p in parts], count


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("features", pa.binary())])


def kind_of(buckets: int) -> np.dtype:
    return np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def featurer(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kind_of(buckets)
        for batch in batches:
            for part in tc.pieces(batch, "text", SHARED):
                found, count = buckets_of(*tc.bytes_of(part.column("text")), most, buckets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count), pa.array([x.astype(kind).tobytes() for x in found], type=pa.binary())], schema=FEATURES)

    return run


def counter(buckets: int):
    """The number of features in each bucket that a task has seen: a row per bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(tc.bytes_of(batch.column("features"))[0].view(kind_of(buckets)), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return run


def weigher(gain: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kind_of(buckets)
        for batch in batches:
            data, offsets = tc.bytes_of(batch.column("features"))
            offsets = offsets // kind.itemsize
            sums = np.concatenate([[0], np.cumsum(gain[data.view(kind)])])
            n = np.diff(offsets)
            total = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def featured(texts: DataFrame, id_col: str, text_col: str, most: int, buckets: int, tag: str) -> DataFrame:
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(featurer(most, buckets), "doc_id long, n_words long, features binary"), tag)


def counted(features: DataFrame, buckets: int, name: str) -> DataFrame:
    return features.select("features").mapInArrow(counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket gains, in thousandths. docs, target: results of `featured`. As many numbers as buckets reach the driver."""
    rows = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted(docs, buckets, "s"), "bucket", "left").join(counted(target, buckets, "t"), "bucket", "left")
    found = {r["bucket"]: (r["s"] or 0, r["t"] or 0) for r in rows.collect()}
    s, t = (np.array([found[k][j] for k in range(buckets)], dtype=np.float64) for j in range(2))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id's digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (place among the drawn, null for others). Drawn are percent of a hundred of the documents with at least min_words words, rounded down."""
    small_batches(docs.sparkSession)
    mine = featured(docs, id_col, text_col, max_words, buckets, "features")
    wanted = featured(target.withColumn(free_name(target, "x_id"), F.lit(0)), free_name(target, "x_id"), target_text, max_words, buckets, "target")
    weighed = mine.mapInArrow(weigher(gains(mine, wanted, buckets), buckets), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= min_words)
    drawn = mine.where(F.col("n_words") >= min_words).count() * percent // 100
    placed = numbered(scored, [F.desc("able"), F.desc("score"), F.asc("doc_id"), F.asc("n_features")], "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: So many ids are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, whose id is drawn; rows without an id are not."""
    key = free_name(docs, "x_drawn")
    drawn = materialise(importance(docs, target, id_col, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct(), "drawn")
    few = drawn.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(drawn) if few else drawn, F.col(id_col).cast("long") == F.col(key), "left_semi")
