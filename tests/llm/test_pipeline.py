import re
import string

import corpus_pipeline
import pytest

from barlattice.llm import sentencepiece_codec

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_each_stage_does_what_brute_force_does(spark, steps):
    start, good, single, apart, clean, coded = steps
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    last = {}
    for r in good:
        k = r["text"].translate(LOW)
        last[k] = max(last.get(k, -1), r["doc_id"])
    assert {r["doc_id"] for r in single} == set(last.values())
    sets = sorted((r["doc_id"], grams(r["text"])) for r in single)
    root = {i: i for i, _ in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["doc_id"] for r in apart} == {i for i in root if find(i) == i}
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    thirteen = {tuple(x[i : i + 13]) for x in items for i in range(len(x) - 12)}
    left = {r["doc_id"] for r in clean}
    for r in apart:
        w = words(r["text"])
        if any(tuple(w[i : i + 13]) in thirteen for i in range(len(w) - 12)):
            assert r["doc_id"] not in left
    assert len(left) >= 0.9 * len(apart) and left <= {r["doc_id"] for r in apart}
    assert {r["doc_id"] for r in coded} == left and all(r["round_trip"] for r in coded)


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in steps[-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    assert sentencepiece_codec.MODEL.startswith("/opt/tokenizers/")
