"""Quality classifier from weak labels: overlapping heuristics, their accuracies by EM, a hashed linear scorer.

1. Ten heuristic labellers vote good, bad or nothing on each whole text (`votes`). The corpus is reduced to the
   number of documents for each pattern of votes: at most 3**10 rows, whatever the input.
2. Expectation-maximisation over those counts estimates the share of good documents and, for each labeller, how
   likely a vote it casts is right on good and on bad documents (`fit_labellers`). That gives each pattern a posterior.
3. A logistic scorer over hashed features (byte trigrams, and the statistics in bins) is trained on the posteriors of a
   bounded sample: the `sample` distinct texts with the smallest hashes (default 8,000), each with the number of its rows as weight. No gold label is used.
4. Every document is scored whole; it is kept if its score is at least 0.5.

Defined results: null, empty and blank texts get score 0 and are not kept. Repeated rows get equal scores. An empty
table gives an empty result. Ids may repeat or be null; extra columns pass through `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, materialise, small_batches

by_value(__name__)

DIMS = 1024
SAMPLE = 8000
KEEP = 0.5

#: Bytes that are symbols rather than text, and those that end a clause.
SYMBOLS = b"#$%&*|<>{}[]~^=_+@\\"
CLAUSE_ENDS = b".,;:?"

#: Statistic, bad if over, good if under (or the reverse where bad < good). Between the two a labeller says nothing.
LABELLERS = (
    ("symbol_share", 0.05, 0.015),
    ("upper_share", 0.30, 0.15),
    ("exclaim_per_word", 0.15, 0.03),
    ("odd_words", 0.10, 0.02),
    ("repeat_share", 0.15, 0.05),
    ("unique_share", 0.25, 0.40),
    ("alnum_share", 0.80, 0.90),
    ("mean_word", 14.0, 10.0),
    ("clause_per_word", 0.005, 0.03),
    ("repeat_lines", 0.40, 0.10),
)


def totals(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def lut(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


def distinct_share(keys: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and keys of each text."""
    code = (of.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20))
    uniq = np.unique(code)
    return np.bincount((uniq >> np.uint64(44)).astype(np.int64), minlength=texts).astype(float), np.bincount(of, minlength=texts).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray, powers: tc.Powers) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    letter = np.zeros(256, dtype=bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    upper = np.zeros(256, dtype=bool)
    upper[65:91] = True
    ascii_letter = letter & (np.arange(256) < 128) & (np.arange(256) > 57)
    solid = totals(~tc.SPACE[data], offsets)
    start, end, of = tc.words(data, offsets)
    n = np.bincount(of, minlength=texts).astype(float)
    div = lambda a, b: np.divide(a, b, out=np.zeros(texts), where=b > 0)
    h = tc.hashes(data, start, end)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    letters = np.concatenate([[0], np.cumsum(letter[data], dtype=np.int64)])
    odd = letters[end] == letters[start]
    unique, _ = distinct_share(h, of, texts)
    # lines: from one newline to the next
    cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][offsets[:-1] < len(data)]).astype(np.int64)
    stop = np.append(cut[1:], len(data)).astype(np.int64)
    line_of = np.searchsorted(offsets, cut, side="right") - 1
    inside = (stop - cut) > 1
    cut, stop, line_of = cut[inside], stop[inside], line_of[inside]
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    lines, all_lines = distinct_share(tc.Rolling(data, powers)(cut, stop) if len(cut) else np.zeros(0, dtype=np.uint64), line_of, texts)
    return {
        "n_words": n,
        "symbol_share": div(totals(lut(SYMBOLS)[data], offsets), solid),
        "upper_share": div(totals(upper[data], offsets), totals(ascii_letter[data], offsets)),
        "exclaim_per_word": div(totals(data == 33, offsets), n),
        "odd_words": div(np.bincount(of, weights=odd, minlength=texts), n),
        "repeat_share": div(np.bincount(of, weights=again, minlength=texts), n),
        "unique_share": np.where(n >= 30, div(unique, n), 0.32),
        "alnum_share": div(totals(letter[data], offsets), solid),
        "mean_word": div(solid, n),
        "clause_per_word": np.where(n >= 30, div(totals(lut(CLAUSE_ENDS)[data], offsets), n), 0.01),
        "repeat_lines": np.where(all_lines >= 4, 1 - div(lines, all_lines), 0.2),
    }


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each labeller: 1 good, 0 bad, 2 nothing."""
    out = np.full((len(stats["n_words"]), len(LABELLERS)), 2, dtype=np.int8)
    for j, (name, bad, good) in enumerate(LABELLERS):
        x = stats[name]
        sign = 1 if bad > good else -1
        out[sign * x >= sign * bad, j] = 0
        out[sign * x <= sign * good, j] = 1
    out[stats["n_words"] == 0] = 0
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over pattern counts: the share of good documents, P(vote | class) by labeller, class, vote, and each pattern's posterior of good."""
    m = len(LABELLERS)
    v = (patterns[:, None] // 3 ** np.arange(m)) % 3
    one = np.stack([v == k for k in range(2)], axis=2).astype(float)  # saying nothing tells nothing: short texts are silent, not bad
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = np.clip((good + 1) / (good + 3 * bad + 2), 0.01, 0.99)
    prior, table = 0.5, np.full((m, 2, 2), 0.5)
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cp,pmk->mck", w, one) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        log = np.einsum("pmk,mck->cp", one, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return prior, table, post


def features(data: np.ndarray, offsets: np.ndarray, stats: dict[str, np.ndarray], dims: int = DIMS) -> np.ndarray:
    """Hashed features of each text: byte trigrams, square roots of their shares, and one feature for each statistic's bin."""
    texts = len(offsets) - 1
    out = np.zeros((texts, dims), dtype=np.float32)
    half = dims // 2
    if len(data) > 2:
        tri = data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | (data[2:].astype(np.uint32) << np.uint32(16))
        slot = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - (half.bit_length() - 1))).astype(np.int64)
        for d in range(texts):
            a, b = offsets[d], offsets[d + 1] - 2
            if b > a:
                out[d, :half] = np.sqrt(np.bincount(slot[a:b], minlength=half) / (b - a))
    for j, (name, bad, good) in enumerate(LABELLERS):
        step = abs(bad - good) / 2
        bin_of = np.clip(np.floor(stats[name] / step), 0, 40).astype(np.uint64)
        key = tc.mix(bin_of * np.uint64(1009) + np.uint64(j + 1))
        np.add.at(out, (np.arange(texts), half + (key % np.uint64(half)).astype(np.int64)), 1.0)
    return out


def train(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of rows that stand for so many each, by accelerated gradient steps; both classes weigh the same."""
    times = times / times.sum()
    share = float(np.clip(y @ times, 0.02, 0.98))
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) * times
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    x = x.astype(np.float64)
    rate = 4.0 / max(1e-9, float((weight * ((x**2).sum(1) + 1)).sum()))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40)))
        g = weight * (p - y)
        nw, nb = vw - rate * (x.T @ g + decay * vw), vb - rate * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


PATTERN = pa.schema([("key", pa.int64()), ("pattern", pa.int64())])
SAMPLED = pa.schema([("key", pa.int64()), ("pattern", pa.int64()), ("x", pa.binary())])


def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = tc.Powers()
    for batch in batches:
        for part in tc.pieces(batch, "text"):
            data, offsets = tc.bytes_of(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(pattern_of(votes(statistics(data, offsets, powers))))], schema=PATTERN)


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = tc.Powers()
    for batch in batches:
        for part in tc.pieces(batch, "text"):
            data, offsets = tc.bytes_of(part.column("text"))
            stats = statistics(data, offsets, powers)
            x = features(data, offsets, stats).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(pattern_of(votes(stats))), pa.array([r.tobytes() for r in x], type=pa.binary())], schema=SAMPLED)


def scorer(w: np.ndarray, b: float, known: dict[int, float], prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tc.Powers()
        for batch in batches:
            for part in tc.pieces(batch, "text"):
                data, offsets = tc.bytes_of(part.column("text"))
                stats = statistics(data, offsets, powers)
                code = pattern_of(votes(stats))
                score = 1 / (1 + np.exp(-np.clip(features(data, offsets, stats) @ w + b, -40, 40)))
                score[stats["n_words"] == 0] = 0.0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(code), pa.array([known.get(int(c), prior) for c in code]), pa.array(score), pa.array(score >= KEEP)], names=["doc_id", "vote_pattern", "posterior", "score", "keep"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model: labeller accuracies, posteriors by pattern and the scorer's weights."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    voted = materialise(keyed.mapInArrow(patterns, "key long, pattern long"), "votes")
    rows = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    codes, counts = np.array([r["pattern"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=float)
    if not len(rows):
        return {"w": np.zeros(DIMS), "b": 0.0, "known": {}, "prior": 0.5, "table": None}
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    prior, table, post = fit_labellers(codes, counts)
    known = dict(zip(codes.tolist(), post.tolist(), strict=True))
    times = {r["key"]: r["n"] for r in voted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key").limit(sample).collect()}
    # a text is taken once however often it is there: one row per task and key is shuffled
    texts = keyed.where(F.col("key") <= max(times)).groupBy("key").agg(F.first("text").alias("text"))
    taken = sorted(texts.mapInArrow(sampled, "key long, pattern long, x binary").collect(), key=lambda r: r["key"])
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in taken]).astype(np.float32)
    w, b = train(x, np.array([known[r["pattern"]] for r in taken]), np.array([times[r["key"]] for r in taken], dtype=float))
    return {"w": w, "b": b, "known": known, "prior": prior, "table": table}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, model: dict | None = None) -> DataFrame:
    """One row per document: doc_id, vote_pattern, posterior, score, keep."""
    model = model or fit(docs, id_col, text_col, sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run = scorer(model["w"], model["b"], model["known"], model["prior"])
    return texts.mapInArrow(run, "doc_id long, vote_pattern long, posterior double, score double, keep boolean")


def keeper(w: np.ndarray, b: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tc.Powers()
        for batch in batches:
            for part in tc.pieces(batch, text_col):
                data, offsets = tc.bytes_of(part.column(part.schema.get_field_index(text_col)))
                stats = statistics(data, offsets, powers)
                score = features(data, offsets, stats) @ w + b
                yield part.filter(pa.array((score >= np.log(KEEP / (1 - KEEP))) & (stats["n_words"] > 0)))

    return run


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, model: dict | None = None) -> DataFrame:
    """The rows of docs, all columns, that the scorer keeps."""
    model = model or fit(docs, id_col, text_col, sample)
    return docs.mapInArrow(keeper(model["w"], model["b"], text_col), docs.schema)
