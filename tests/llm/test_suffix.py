import bisect
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from barlattice.llm import corpus_order, suffix_dedup


def covered(texts, span, want):
    """Which bytes of each text are under strings of span(text, place) bytes that start at two places or more."""
    count = collections.Counter()
    for _, b in texts:
        for p in range(len(b)):
            count[b[p : p + want]] += len(b) - p >= want
    for i, b in texts:
        gone, end = bytearray(len(b)), 0
        for p in range(len(b)):
            n = span(b, p)
            if n == want and p + n <= len(b) and count[b[p : p + n]] > 1:
                gone[max(p, end) : p + n] = b"\1" * (p + n - max(p, end))
                end = max(end, p + n)
        yield i, b, gone


def brute(rows, length, short=200, words=50):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    ends = {b: [m.end() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for _, b in texts}

    def span(b, p):
        k = bisect.bisect_right(ends[b], p) + words - 1
        return min(max(ends[b][k] + 1 - p, short), length) if k < len(ends[b]) and ends[b][k] < len(b) else length

    out = collections.Counter()
    less = [bytearray(len(b)) for _, b in texts]
    for n in sorted({span(b, p) for _, b in texts for p in range(len(b))} - {length}):
        for k, (_, _, gone) in enumerate(covered(texts, span, n)):
            less[k] = bytearray(x | y for x, y in zip(less[k], gone, strict=True))
    for (i, b, gone), part in zip(covered(texts, lambda b, p: length, length), less, strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), sum(x | y for x, y in zip(gone, part, strict=True)))] += 1
    return out


FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


@pytest.mark.parametrize(("length", "short", "words", "phrase", "block", "hot"), [(400, 200, 50, 24, 4 << 20, 8192), (60, 40, 9, 8, 3000, 8192), (60, 40, 9, 8, 3000, 2), (100, 100, 50, 200, 20000, 8)])
def test_removes_what_brute_force_removes(docs, made, length, short, words, phrase, block, hot):
    made = [r for r in made if len(r[1] or "") < 20000]
    got = suffix_dedup.remove_repeats(docs.where("length(text) < 20000 or text is null"), length=length, short=short, words=words, phrase=phrase, hot=hot, block_bytes=block).collect()
    assert collections.Counter(tuple(r[f] for f in FIELDS) for r in got) == brute(made, length, short, words)


def test_long_periodic_text(spark):
    rows = [(1, "orre " * 6000), (2, "x" * 5000), (3, "x" * 399), (4, "orre " * 81)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 30000, 2: 5000, 3: 0, 4: 405}


def test_equal_hashes_do_not_remove(spark):
    """Thue-Morse words and their complement differ in every character, but hash alike modulo a power of two."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    want = brute(rows, 400)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(tuple(r[f] for f in FIELDS) for r in got) == want


def test_suffix_order_and_longest_repeats():
    rnd = random.Random(3)
    for _ in range(60):
        letters = rnd.choice([b"ab", b"a", b"ab\0", bytes(range(256)), b"abcdefgh \n"])
        make = lambda n: bytes(rnd.choice(letters) for _ in range(n))  # noqa: B023, E731
        base = make(rnd.randint(0, 150))
        texts = [make(rnd.randint(0, 20)) + base[rnd.randint(0, 60) : rnd.randint(60, 150)] + make(rnd.randint(0, 20)) for _ in range(rnd.randint(0, 5))]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        suffixes = [t[k:] for t in texts for k in range(len(t))]
        starts = np.arange(len(data))
        order = corpus_order.suffix_order(data, offsets, starts, 4, 400)
        assert [suffixes[k] for k in order] == sorted(suffixes)
        limit = rnd.choice([16, 400])
        longest = lambda j: max((next((n for n, (x, y) in enumerate(zip(suffixes[j], s, strict=False)) if x != y), min(len(s), len(suffixes[j]))) for k, s in enumerate(suffixes) if k != j), default=0)  # noqa: B023, E731
        got = corpus_order.longest_repeats(data, offsets, starts, 4, limit)
        for j in rnd.sample(range(len(suffixes)), min(8, len(suffixes))):
            assert got[j] == min(longest(j), limit)


def test_empty_table_and_kept_bytes(docs, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    for r in suffix_dedup.remove_repeats(docs, with_kept=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
