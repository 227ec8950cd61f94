"""The divergence audit against plain Python with whole numbers, in one shard and in many."""

import collections
import re
import string

import pytest

from barlattice.llm import divergence as dv

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_docs=3, leaders=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for text, lang, source in rows]
    docs, n = collections.Counter(), collections.Counter()
    for lang, source, ws in words:
        docs.update((lang, w) for w in set(ws))
        n.update((lang, source, w) for w in ws)
    out = []
    for lang in {x[0] for x in words}:
        kept = [w for (a, w), c in docs.items() if a == lang and c >= min_docs]
        sources = sorted({s for a, s, _ in words if a == lang})
        size = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (n[lang, s, w] + 1) // (size[s] + len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (sum(n[lang, s, w] for s in sources) + 1) // (sum(size.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, leaders)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.fixture(scope="module")
def rows(made):
    texts = [r[1] for r in made]
    out = [(t, (None, "en", "", "dé")[k % 4] if k % 9 else "xx", f"s{k % 5}" if k % 7 else None) for k, t in enumerate(texts)]
    return [*out, *out[:12], ("123 !", "en", "no terms"), ("rare words here", "only", "a"), (None, "only", "b"), (" ".join(["Ab"] * 50_000), "en", "s1"), ("ab cd", "one", "alone"), ("ab", "one", "alone"), ("ab", "one", "alone")]


@pytest.mark.parametrize(("shard_rows", "leaders"), [(250_000, 200), (97, 200), (97, 3)])
def test_every_row_equals_plain_python(spark, rows, shard_rows, leaders):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = dv.audit(docs, shard_rows=shard_rows, leaders=leaders)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, leaders=leaders)


def test_empty_table_and_blank_rows(spark):
    schema = "text string, lang string, source string"
    assert dv.audit(spark.createDataFrame([], schema)).count() == 0
    assert sorted(tuple(r) for r in dv.audit(spark.createDataFrame([(None, None, None), ("a", None, "b")], schema)).collect()) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
