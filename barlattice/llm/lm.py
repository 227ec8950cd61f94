"""Language-model scoring by deleted interpolation: bigram, unigram and uniform estimates, mixed by context frequency.

Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end per text, a token too. Texts whose
crc32(doc_id as text) mod 5 is 1 are held out; all others train. Of those, the texts with remainder 4 are deleted,
once: maximum-likelihood estimates from the rest predict them, and expectation-maximisation over their tokens
learns, for each bucket of context frequency (powers of two), the weights of the three estimates. The final model
mixes, by those weights, the estimates from all training texts:

    p(w | v) = a * c(v, w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1)

Counts cover the whole corpus: blocks of documents send their distinct words and word pairs with counts and get the
totals back (`blocks.exchange`), so what moves grows with the corpus and no task holds more than its share. For the
weights, only a histogram of quantised estimate ratios reaches the driver; its sides grow with the logarithm of counts, so no ratio is clipped.

Defined results: null text is the empty text, whose only token is its end; a null doc_id counts as the empty string;
repeated rows are scored and counted each. Without any training text counts are 0 and the uniform estimate remains.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import blocks as bl
from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value

by_value(__name__)

FOLDS, HELD_OUT, DELETED = 5, 1, 4
#: Hashes of the end of a text, and of what stands before its first word.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Context-frequency buckets: none, then powers of two.
BUCKETS = 24
#: Steps per factor of two in the histogram of estimate ratios, and its least number of places.
STEPS, SPAN = 8, 320


def folds(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS for x in ids.to_pylist()], dtype=np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and offsets by text."""
    parts, counts = [], []
    for _, _, part, off in bl.pieces_of(data, offsets):
        start, end, of = tc.words(part, off)
        texts = len(off) - 1
        n = np.bincount(of, minlength=texts)
        h = np.full(len(start) + texts, END, dtype=np.uint64)
        if len(start):
            h[np.arange(len(start)) + of] = tc.hashes(tc.LOWER[part], start, end)
        parts.append(h)
        counts.append(n + 1)
    size = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def pairs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts, and of context and token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = START
    return before, tc.mix(before * PAIR + h)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys, kind="stable")
    at, run_of = tc.sorted_runs(keys[order])
    place = np.empty(len(keys), dtype=np.int32)
    place[order] = np.repeat(np.arange(len(at), dtype=np.int32), run_of)
    return keys[order[at]], place


def key_counter(kind: str):
    def keys_of(row: dict) -> tuple:
        ids, data, offsets = bl.docs_of(row)
        fold = folds(ids)
        h, at = tokens(data, offsets)
        token_fold = np.repeat(fold, np.diff(at))
        key, place = distinct(h if kind == "words" else pairs(h, at)[1])
        train = token_fold != HELD_OUT
        deleted = token_fold == DELETED
        main = np.bincount(place[train & ~deleted], minlength=len(key)).astype(np.uint32)
        rest = np.bincount(place[deleted], minlength=len(key)).astype(np.uint32)
        return key, main, rest

    return keys_of


def both_counts(first: np.ndarray, second: np.ndarray, lead: np.ndarray) -> bytes:
    return bl.pack_counts(first) + bl.pack_counts(second)


def answers(cells: list) -> tuple[np.ndarray, np.ndarray]:
    first, second = [], []
    for raw in cells:
        x, at = bl.unpack_counts(raw)
        first.append(x)
        second.append(bl.unpack_counts(raw, at)[0])
    return np.concatenate(first).astype(np.int64), np.concatenate(second).astype(np.int64)


class Counted:
    """A block's tokens with their corpus counts."""

    def __init__(self, row: dict) -> None:
        self.ids, data, offsets = bl.docs_of(row)
        self.fold = folds(self.ids)
        h, self.at = tokens(data, offsets)
        before, pair = pairs(h, self.at)
        word, place = distinct(h)
        _, pair_place = distinct(pair)
        main, rest = answers(row["replies"][0])
        pair_main, pair_rest = answers(row["replies"][1])
        end = int(np.searchsorted(word, END))
        context = np.where(before == START, end, np.concatenate([[0], place[:-1]]))
        self.main = (pair_main[pair_place], main[context], main[place])
        self.all = tuple(a + b for a, b in zip(self.main, (pair_rest[pair_place], rest[context], rest[place]), strict=True))


def bucket_of(context: np.ndarray) -> np.ndarray:
    out = np.zeros(len(context), dtype=np.int64)
    some = context > 0
    out[some] = np.minimum(1 + np.log2(context[some]).astype(np.int64), BUCKETS - 1)
    return out


def estimates(counts: tuple, total: int, types: int) -> tuple[np.ndarray, np.ndarray, float]:
    pair, context, word = counts
    return np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0), word / max(1, total), 1 / (types + 1)


def span_of(total: int, types: int) -> int:
    """Places that hold every ratio: of pair / context it lies within (types + 1) / total and types + 1, and of word / total likewise."""
    largest = max(types + 1, total / (types + 1), 1)
    return max(SPAN, 2 * (STEPS * math.ceil(math.log2(largest)) + 2))


CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64())])


def quantised(ratio: np.ndarray, span: int = SPAN) -> np.ndarray:
    """0 for a ratio of 0, else its logarithm in steps, from 1."""
    out = np.zeros(len(ratio), dtype=np.int64)
    some = ratio > 0
    out[some] = np.clip(np.rint(STEPS * np.log2(ratio[some])) + span // 2, 0, span - 2).astype(np.int64) + 1
    return out


def cells_of(total: int, types: int):
    span = span_of(total, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in bl.rows_of(batch, 2):
                c = Counted(row)
                mine = np.repeat(c.fold == DELETED, np.diff(c.at))
                counts = tuple(x[mine] for x in c.main)
                two, one, zero = estimates(counts, total, types)
                cell = (bucket_of(counts[1]) * span + quantised(two / zero, span)) * span + quantised(one / zero, span)
                key, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], schema=CELLS)

    return run


def fit_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 100, span: int = SPAN) -> np.ndarray:
    """EM by bucket: weights of bigram, unigram and uniform estimates. Buckets without data take those of the next lower one that has."""
    b, rest = cells // span**2, cells % span**2
    ratio = lambda q: np.where(q > 0, 2.0 ** ((q - 1 - span // 2) / STEPS), 0.0)
    parts = np.stack([ratio(rest // span), ratio(rest % span), np.ones(len(cells))], axis=1)
    out = np.zeros((BUCKETS, 3))
    known = np.array([0.0, 0.9, 0.1])
    for k in range(BUCKETS):
        p, n = parts[b == k], counts[b == k].astype(float)
        if n.sum():
            w = np.array([0.0 if k == 0 else 0.4, 0.5, 0.1])
            w /= w.sum()
            for _ in range(rounds):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                w = (n[:, None] * share).sum(axis=0)
                w = (w + np.array([0.0 if k == 0 else 1e-3, 1e-3, 1e-3])) / (n.sum() + (2e-3 if k == 0 else 3e-3))
            known = w
        out[k] = known
    return out


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scorer(weights: np.ndarray, total: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in bl.rows_of(batch, 2):
                c = Counted(row)
                two, one, zero = estimates(c.all, total, types)
                w = weights[bucket_of(c.all[1])]
                p = w[:, 0] * two + w[:, 1] * one + w[:, 2] * zero
                base = np.log10((c.all[2] + 0.5) / (total + 0.5 * (types + 1)))
                start = c.at[:-1]
                n = np.diff(c.at)
                yield pa.RecordBatch.from_arrays([c.ids, pa.array(c.fold == HELD_OUT), pa.array(n), pa.array(np.add.reduceat((c.all[2] > 0).astype(np.int64), start)), pa.array(np.full(len(n), total)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(np.log10(p), start))], schema=SCORED)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    table, size = bl.make_blocks(docs, id_col, text_col, block_bytes)
    words = bl.exchange(table, key_counter("words"), both_counts, size / 40)
    both = bl.exchange(table, key_counter("pairs"), both_counts, size / 10)
    types, main, deleted = words.agg(F.sum("types"), F.sum("first"), F.sum("second")).first()
    types, main, total = int(types or 0), int(main or 0), int((main or 0) + (deleted or 0))
    told = bl.attach(table, words, both)
    cells = told.mapInArrow(cells_of(main, types), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = fit_weights(np.array([r["cell"] for r in cells], dtype=np.int64), np.array([r["n"] for r in cells], dtype=np.int64), span=span_of(main, types))
    return told.mapInArrow(scorer(weights, total, types), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
