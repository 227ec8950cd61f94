import collections

import numpy as np
import pytest

from barlattice.llm import components, ngram_join


def grams(text):
    w = (text or "").lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """Per row: number of links and the smallest id of its component."""
    sets = [grams(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[find(k)].append(i)
    return collections.Counter((i, links[k], min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 3])
def test_join_is_the_brute_force_one(docs, made, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = collections.Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in ngram_join.near_classes(docs).collect())
    assert got == brute(made)


def test_join_by_shuffles_gives_the_same(docs, made, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = collections.Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in ngram_join.near_classes(docs).collect())
    assert got == brute(made)


def test_keep_one(docs, made, empty):
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    want = {i for i, _, least in brute(made) if i == least or least is None}
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == {i for i in want if i is not None}
    assert ngram_join.near_classes(empty).count() == 0


def test_helper_columns_take_free_names(spark, made):
    docs = spark.createDataFrame([(1, made[61][1], 5), (2, made[61][1], 6)], "doc_id long, text string, x_gone int")
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [1]


def test_prefixes_are_shortened_until_the_recall():
    assert ngram_join.last_depth(0.8, 0.99999, 24, 5) == 4
    assert ngram_join.recall_at(0.8, 24, 4) >= 0.99999 > ngram_join.recall_at(0.8, 24, 5)


def test_measured_recall_of_each_prefix_length():
    """Pairs of sets at the threshold: the share that meets in some tree, by length, is that of the formula."""
    rng = np.random.default_rng(4)
    trees, depth, pairs = 24, 5, 3000
    meets = np.zeros(depth + 1)
    factors = ngram_join.seeds(trees * depth)
    for _ in range(pairs):
        both, a, b = np.split(rng.integers(0, 2**63, 100, dtype=np.uint64), [80, 90])
        sigs = [ngram_join.minhash(x, np.array([0, 90]), factors)[0].reshape(trees, depth) for x in (np.concatenate([both, a]), np.concatenate([both, b]))]
        same = np.cumprod(sigs[0] == sigs[1], axis=1).any(axis=0)
        meets[1:] += same
    for length in range(1, depth + 1):
        assert meets[length] / pairs == pytest.approx(ngram_join.recall_at(0.8, trees, length), abs=0.015)


@pytest.mark.parametrize("block", [512, 4])
def test_forest_finds_the_groups_and_shares_no_pair_twice(spark, block, monkeypatch):
    """Near copies of a few bases and a crowded node: all members of a base end in one group, others stay alone."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(9)
    bases = rng.integers(0, 2**32, (6, 120), dtype=np.uint32)
    rows, want = [], []
    for k in range(90):
        sig = bases[k % 6].copy()
        sig[rng.integers(0, 120, 4)] = rng.integers(0, 2**32, 4, dtype=np.uint32)
        rows.append((k, bytearray(sig.tobytes())))
        want.append(k % 6)
    for k in range(90, 120):  # these share the first tree's label and nothing else
        sig = rng.integers(0, 2**32, 120, dtype=np.uint32)
        sig[:5] = bases[0][:5]
        rows.append((k, bytearray(sig.tobytes())))
        want.append(k)
    got = {r["cid"]: r["root"] for r in ngram_join.forest(spark.createDataFrame(rows, "cid long, sig binary"), 0.8, 24, 5, 0.99999).collect()}
    assert [got[k] for k in range(120)] == want


def test_texts_of_equal_structure_are_told_apart(spark):
    """Sequences whose words follow the Thue-Morse sequence and its complement: no sum of powers tells them apart."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    words = "".join("ab"[b] for b in bits)
    rows = [(1, " ".join("xy"[b] for b in bits)), (2, " ".join("yx"[b] for b in bits)), (3, words), (4, words.translate(str.maketrans("ab", "ba")))]
    got = {r["doc_id"]: r["copy_id"] for r in ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_components_of_chains_cliques_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100 + a, 100 + b) for a in range(6) for b in range(a)] + [(200, 200 + k) for k in range(1, 40)] + [(300, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(21)}, **{100 + k: 100 for k in range(6)}, **{200 + k: 200 for k in range(40)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("top", [0, 1500])
def test_blocks_of_a_crowded_node_are_bounded_and_cover_every_pair(spark, top):
    """A node of 4,000 classes, `top` of them in one group: no block holds over two blocks' classes, and any two classes of different groups meet once."""
    n = 4000
    rows = [(9, k, 0 if k < top else k) for k in range(n)] + [(8, 10_000 + k, 10_000 + k) for k in range(20)]
    blocks = collections.defaultdict(list)
    for r in ngram_join.block_pairs(spark.createDataFrame(rows, "trie long, cid long, root long")).collect():
        assert r["trie"] == 9
        blocks[r["block"]].append((r["cid"], r["root"], r["side"]))
    assert max(map(len, blocks.values())) < 2 * ngram_join.BLOCK * 1.3
    met = np.zeros((n, n), dtype=np.int8)
    for members in blocks.values():
        left, right = ([c for c, _, s in members if s == k] for k in range(2))
        met[np.ix_(left, right if right else left)] += 1
    met += met.T
    root = np.array([r[2] for r in rows[:n]])
    apart = root[:, None] != root[None, :]
    assert (met[apart] >= 1).all() and (met[apart] <= 2).all()


def test_texts_of_one_template_are_not_linked(spark):
    """Texts that share 300 words of 520 in one run: crowded nodes, no links; two of them are near copies."""
    rng = np.random.default_rng(2)
    shared = [f"s{k}" for k in range(300)]
    texts = [" ".join(shared + [f"w{x}" for x in rng.integers(0, 10**9, 220)]) for _ in range(1500)]
    texts.append(texts[3] + " tail")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: (3, 1) if k in (3, 1500) else (k, 0) for k in range(1501)}
