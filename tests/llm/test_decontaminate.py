import itertools
import re

from barlattice.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for i, t, *_ in docs:
        w = words(t)
        for k, it in items:
            x = words(it)
            n = min(len(x), d.WINDOW)
            if n < d.SHORTEST:
                continue
            for shift in range(-len(x) + 1, len(w)):
                same = [0 <= shift + j < len(w) and w[shift + j] == x[j] for j in range(len(x))]
                best = max(sum(same[a : a + n]) for a in range(len(x) - n + 1))
                if best >= d.needed(n):
                    old = out.get((i, k))
                    if old is None or (best, -shift) > (old[0], -old[1]):
                        out[(i, k)] = (best, shift)
    return out


def test_overlaps_are_those_of_brute_force(spark, docs, made, empty):
    long = made[61][1].split()
    swapped = [w if k % 5 else "other" for k, w in enumerate(long[20:60])]
    items = [(1, " ".join(long[40:80])), (2, " ".join(swapped)), (3, "a b c d"), (4, None), (5, "x y"), (6, " ".join(made[3][1].split()[:9])), (7, "nothing of this kind is in there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [r for r in made if r[0] not in (500, 501)]
    small = docs.where("doc_id IS NULL OR doc_id NOT IN (500, 501)")
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["doc_word"]) for r in d.overlaps(small, bench).collect()}
    assert got == brute(rows, items)
    assert d.overlaps(empty, bench).count() == 0
    assert d.overlaps(docs, bench.limit(0)).count() == 0
    left = d.drop_contaminated(small, bench)
    assert left.columns == docs.columns
    bad = {i for i, _ in got}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)


def test_shuffled_joins_give_the_same(spark, docs, made, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(made[61][1].split()[40:80]))], "item_id long, text string")
    want = sorted(map(tuple, d.overlaps(docs, bench).collect()))
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(d, "BROADCAST_HITS", 0)
    assert want == sorted(map(tuple, d.overlaps(docs, bench).collect())) and want


def test_many_alignments_give_the_same(spark, docs, made, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(made[61][1].split()[40:80]))], "item_id long, text string")
    want = sorted(map(tuple, d.overlaps(docs, bench).collect()))
    monkeypatch.setattr(d, "BROADCAST_HITS", 0)
    assert want == sorted(map(tuple, d.overlaps(docs, bench).collect())) and want


def test_helper_columns_take_free_names(spark, made):
    docs = spark.createDataFrame([(1, made[61][1], 5), (2, "something else", 6)], "doc_id long, text string, x_bad int")
    bench = spark.createDataFrame([(1, " ".join(made[61][1].split()[40:80]))], "item_id long, text string")
    left = d.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "something else", 6)]


def test_masks_lose_no_window():
    assert d.lossless(d.MASKS, d.WINDOW) and not d.lossless(((0, 1, 2, 3, 4),), d.WINDOW)
    for n in range(d.SHORTEST, d.WINDOW + 1):
        assert d.lossless(d.SHORT_MASKS, n), n
        for k in range(n - d.needed(n) + 1):
            for wrong in itertools.combinations(range(n), k):
                masks = d.MASKS if n == d.WINDOW else d.SHORT_MASKS
                assert any(all(a + o not in wrong for o in m) for m in masks for a in range(n - m[-1])), (n, wrong)
