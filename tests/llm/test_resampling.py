"""Importance resampling against a plain-Python version; suffix arrays and runs against sorted n-grams."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest

from barlattice.llm import resampling as rs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(k, *features(t, most)) for k, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, fs in found:
        for f in fs:
            s[bucket(f)] += 1
    for x in target:
        for f in features(x, most)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for k, n, fs in found:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    place = {}
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        place.setdefault(r, []).append(n)
    return sorted(((*r[:4], place[r].pop() if place.get(r) else None) for r in rows), key=str)


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97), (2, 100_000)])
def test_every_row_equals_plain_python(spark, docs, made, most, buckets):
    target = [made[3][1], None, made[66][1]]
    wanted = spark.createDataFrame([(x, 1) for x in target], "text string, x_id int")
    got = rs.importance(docs, wanted, max_words=most, buckets=buckets, percent=40)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in made], target, most, buckets, 20, 40)


def test_empty_tables(spark, docs, empty):
    assert rs.importance(empty, docs).count() == 0
    assert rs.importance(docs, empty).count() == docs.count()


def test_resample_keeps_whole_rows(docs, made):
    drawn = [r["doc_id"] for r in rs.importance(docs, docs, percent=30).where("rank IS NOT NULL").collect()]
    kept = rs.resample(docs, docs, percent=30)
    assert kept.columns == docs.columns and drawn
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((r for r in made if r[0] is not None and r[0] in drawn), key=str)


def test_runs_are_the_distinct_ngrams():
    rnd = random.Random(3)
    texts = [[rnd.randint(0, 4) for _ in range(rnd.randint(0, 30))] for _ in range(40)] + [[1] * 200]
    ids = np.array([w for t in texts for w in t], dtype=np.int64)
    left = np.array([len(t) - i for t in texts for i in range(len(t))], dtype=np.int64)
    for n, at, heads in rs.runs(ids, left, 5):
        gram = [tuple(ids[p : p + n]) for p in at]
        assert gram == sorted(gram) and len(at) == int((left >= n).sum())
        assert [gram[h] for h in heads] == sorted(set(gram))
