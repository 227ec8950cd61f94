import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_labels_agree(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_documents(docs).join(labels, "doc_id").select("keep", "quality").collect()
    wrong = sum(r["keep"] != (r["quality"] == 1) for r in rows)
    assert wrong / len(rows) < 0.02
    assert sum(not r["keep"] for r in rows if r["quality"] == 1) / len(rows) < 0.01


def test_edges(docs, made, empty):
    rows = quality.score_documents(docs).collect()
    assert len(rows) == len(made)
    assert all(r["score"] == 0 and not r["keep"] for r in rows if r["doc_id"] in (400, 401, 402))
    assert quality.score_documents(empty).count() == 0
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and left.count() == sum(r["keep"] for r in rows)
    assert quality.keep_good(empty).count() == 0


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(0)
    n, m = 20_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.7
    right = np.linspace(0.65, 0.95, m)
    v = np.where(rng.random((n, m)) < right, truth[:, None], ~truth[:, None]).astype(np.int8)
    v[rng.random((n, m)) < 0.3] = 2
    codes, counts = np.unique(quality.pattern_of(v), return_counts=True)
    prior, table, post = quality.fit_labellers(codes, counts.astype(float))
    assert prior == pytest.approx(0.7, abs=0.02)
    assert np.abs(table[:, 1, 1] - right).max() < 0.03 and np.abs(table[:, 0, 0] - right).max() < 0.03
    known = dict(zip(codes, post, strict=True))
    assert np.mean([(known[c] > 0.5) == t for c, t in zip(quality.pattern_of(v), truth, strict=True)]) > 0.95


def plain_statistics(text):
    """The statistics of one text, word by word and byte by byte."""
    b = (text or "").encode()
    letters = lambda x: sum(48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in x)
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, solid = len(words), sum(map(len, words))
    lines = [x[:-1] if x.endswith(b"\n") else x for x in re.findall(rb"[^\n]*\n|[^\n]+", b) if len(x) > 1]
    ascii_letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in b)
    div = lambda x, y: x / y if y else 0.0
    return {
        "n_words": n,
        "symbol_share": div(sum(c in quality.SYMBOLS for c in b), solid),
        "upper_share": div(sum(65 <= c <= 90 for c in b), ascii_letters),
        "exclaim_per_word": div(b.count(b"!"), n),
        "odd_words": div(sum(not letters(w) for w in words), n),
        "repeat_share": div(sum(x == y for x, y in zip(words, words[1:], strict=False)), n),
        "unique_share": len(set(words)) / n if n >= 30 else 0.32,
        "alnum_share": div(letters(b), solid),
        "mean_word": div(solid, n),
        "clause_per_word": sum(c in quality.CLAUSE_ENDS for c in b) / n if n >= 30 else 0.01,
        "repeat_lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.2,
    }


def plain_vote(x, bad, good):
    if bad > good:
        return 1 if x <= good else 0 if x >= bad else 2
    return 1 if x >= good else 0 if x <= bad else 2


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * factor % 2**64
    return x


def plain_score(text, stats, w, b):
    raw, half = (text or "").encode(), quality.DIMS // 2
    x = np.zeros(quality.DIMS)
    for p in range(len(raw) - 2):
        x[int.from_bytes(raw[p : p + 3], "little") * 0x9E3779B1 % 2**32 >> (32 - 9)] += 1 / (len(raw) - 2)
    x = np.sqrt(x)
    for j, (name, bad, good) in enumerate(quality.LABELLERS):
        place = min(max(math.floor(stats[name] / (abs(bad - good) / 2)), 0), 40)
        x[half + plain_mix((place * 1009 + j + 1) % 2**64) % half] += 1
    return 1 / (1 + math.exp(-(x @ w + b))) if stats["n_words"] else 0.0


def test_votes_and_scores_are_the_plain_ones(spark, docs, made):
    model = quality.fit(docs)
    texts = [(k, t) for k, (_, t, *_) in enumerate(made)] + [(900, "line a\nline a\nline a\nline b\n\n"), (901, "AB!! " * 40), (902, "#$ %& <> " * 30)]
    got = {r["doc_id"]: r for r in quality.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), model=model).collect()}
    for k, t in texts:
        stats = plain_statistics(t)
        votes = [plain_vote(stats[name], bad, good) if stats["n_words"] else 0 for name, bad, good in quality.LABELLERS]
        assert got[k]["vote_pattern"] == sum(v * 3**j for j, v in enumerate(votes)), (k, stats)
        assert got[k]["score"] == pytest.approx(plain_score(t, stats, model["w"], model["b"]), abs=1e-4)
        assert got[k]["posterior"] == model["known"].get(got[k]["vote_pattern"], model["prior"])


def test_posteriors_are_those_of_plain_em(docs, made):
    """The same expectation-maximisation over single documents instead of pattern counts."""
    model = quality.fit(docs)
    every = [[plain_vote(s[name], bad, good) if s["n_words"] else 0 for name, bad, good in quality.LABELLERS] for s in (plain_statistics(t) for _, t, *_ in made)]
    post = [min(max((v.count(1) + 1) / (v.count(1) + 3 * v.count(0) + 2), 0.01), 0.99) for v in every]
    for _ in range(200):
        prior = (sum(post) + 1) / (len(post) + 2)
        table = [[[sum((q if c else 1 - q) for q, v in zip(post, every, strict=True) if v[m] == k) + 0.5 for k in range(2)] for c in range(2)] for m in range(len(quality.LABELLERS))]
        right = lambda m, c, k: table[m][c][k] / sum(table[m][c])  # noqa: B023, E731
        new = []
        for v in every:
            odds = [(prior if c else 1 - prior) * math.prod(right(m, c, k) for m, k in enumerate(v) if k < 2) for c in range(2)]
            new.append(odds[1] / sum(odds))
        done, post = max(abs(x - y) for x, y in zip(post, new, strict=True)) < 1e-9, new
        if done:
            break
    for q, v in zip(post, every, strict=True):
        assert model["known"][sum(k * 3**j for j, k in enumerate(v))] == pytest.approx(q, abs=1e-6)


@pytest.mark.parametrize("text", ["the same words again and again, said once more.", "#### $$$$ !!!!", "", None])
def test_a_table_of_equal_rows(spark, text):
    rows = spark.range(80_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).cast("string").alias("text"))
    got = quality.score_documents(rows).groupBy("score", "keep").count().collect()
    assert len(got) == 1 and got[0]["count"] == 80_000
    assert quality.keep_good(rows).count() == (80_000 if got[0]["keep"] else 0)


def test_sample_is_bounded_weighted_and_the_same_in_any_order(spark, docs, made, monkeypatch):
    """Half of the rows are copies of one text; the fit takes 20 distinct texts whatever the order of rows."""
    seen = []
    plain = quality.train
    monkeypatch.setattr(quality, "train", lambda x, y, times, **how: seen.append((len(x), times.sum())) or plain(x, y, times, **how))
    some = docs.select("doc_id", "text").where("text is not null")
    many = some.unionByName(spark.range(200).select(F.col("id").alias("doc_id"), F.lit(made[5][1]).alias("text")))
    models = [quality.fit(many.repartition(n), sample=20) for n in (1, 5)]
    assert all(n == 20 for n, _ in seen) and seen[0] == seen[1]
    assert (models[0]["w"] == models[1]["w"]).all() and models[0]["b"] == models[1]["b"]
    assert quality.fit(some, sample=1000)["known"].keys() == quality.fit(docs, sample=1000)["known"].keys()
