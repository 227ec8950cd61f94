import collections
import math
import re
import zlib

import numpy as np
import pytest

from barlattice.llm import blocks, lm


def test_scores(docs, made, empty):
    tok = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]) for i, t, *_ in made]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5

    def counts(keep):
        one, two = collections.Counter(), collections.Counter()
        for i, w in tok:
            if keep(fold(i)):
                one.update(w)
                two.update(zip(["<s>", *w], w, strict=False))
        return one, two

    one, two = counts(lambda f: f != 1)
    main, main2 = counts(lambda f: f not in (1, 4))
    total, types = sum(one.values()), len(one)
    of = lambda c, v: c["</s>"] if v == "<s>" else c[v]
    bucket = lambda c: 0 if c == 0 else min(1 + int(math.log2(c)), lm.BUCKETS - 1)
    seen = collections.defaultdict(list)
    for i, w in tok:
        if fold(i) == 4:
            for v, x in zip(["<s>", *w], w, strict=False):
                c = of(main, v)
                seen[bucket(c)].append((main2[(v, x)] / c if c else 0, main[x] / sum(main.values()), 1 / (types + 1)))
    weights, last = {}, np.array([0.0, 0.9, 0.1])
    for k in range(lm.BUCKETS):
        if k in seen:
            p, w = np.array(seen[k]), np.array([0.0 if k == 0 else 0.4, 0.5, 0.1])
            w /= w.sum()
            for _ in range(100):
                s = p * w / (p * w).sum(1, keepdims=True)
                w = (s.sum(0) + np.array([0.0 if k == 0 else 1e-3, 1e-3, 1e-3])) / (len(p) + (2e-3 if k == 0 else 3e-3))
            last = w
        weights[k] = last
    want = []
    for i, w in tok:
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        score = 0.0
        for v, x in zip(["<s>", *w], w, strict=False):
            c = of(one, v)
            a, b, z = weights[bucket(c)]
            score += math.log10((a * two[(v, x)] / c if c else 0) + b * one[x] / total + z / (types + 1))
        want.append((str(i), len(w), base, fold(i) == 1, sum(one[x] > 0 for x in w), score))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["base_score"], r["held_out"], r["n_known"], r["score"], r["train_tokens"]) for r in lm.score_texts(docs, block_bytes=5000).collect())
    for g, x in zip(got, sorted(want), strict=True):
        assert g[:2] == x[:2] and g[3:5] == x[3:5] and g[6] == total
        assert g[2] == pytest.approx(x[2], abs=1e-9) and g[5] == pytest.approx(x[5], rel=0.01)
    assert lm.score_texts(empty).count() == 0


def test_words_of_equal_structure_are_told_apart(spark):
    """A word of 1,024 letters after the Thue-Morse sequence, and its complement: the second, held out, is unknown."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    train = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 2)
    rows = [(train, word), (held, word.translate(str.maketrans("ab", "ba")))]
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[train]["n_known"] == 2 and got[held]["n_known"] == 1
    assert got[held]["base_score"] == pytest.approx(math.log10(0.5 / (2 + 1.5)) + math.log10(1.5 / (2 + 1.5)))


def test_weights_of_a_known_mixture():
    rng = np.random.default_rng(1)
    q = lm.quantised(np.array([2.0**6]))[0]
    cells = np.where(rng.random(5000) < 0.5, (3 * lm.SPAN + q) * lm.SPAN, (3 * lm.SPAN) * lm.SPAN)
    key, n = np.unique(cells, return_counts=True)
    w = lm.fit_weights(key, n)
    assert w[3].sum() == pytest.approx(1) and w[3][0] == pytest.approx(0.5, abs=0.03)


@pytest.mark.parametrize("bits", [0, 5])
def test_packed_keys_and_counts(bits):
    keys = np.sort(np.unique(np.random.default_rng(2).integers(0, 2**63, 9000, dtype=np.uint64)))
    top = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), dtype=np.uint64)
    for b in np.unique(top):
        own = keys[top == b]
        assert np.array_equal(blocks.unpack_keys(blocks.pack_keys(own, bits), bits, int(b)), own)
        few = own[:10]
        assert np.array_equal(blocks.unpack_keys(blocks.pack_keys(few, bits), bits, int(b)), few)
    x = np.array([0, 1, 254, 255, 256, 70000], dtype=np.uint32)
    assert np.array_equal(blocks.unpack_counts(blocks.pack_counts(x))[0], x)
