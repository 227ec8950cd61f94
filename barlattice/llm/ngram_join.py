"""Jaccard self-join on word 5-grams: a MinHash LSH forest, then exact verification.

1. One pass over the texts gives each a signature of trees x depth minhashes over its set of word n-grams, and a
   128-bit digest of its word sequence. Equal sequences are one class with a number of copies; classes go on.
2. Forest: a tree's label is `depth` minhashes; the classes that share a prefix of it are a node of its trie. Prefixes
   are matched from full length on and shortened one minhash at a time until a pair at the threshold meets in some tree
   with the target recall (`last_depth`). Only nodes that hold two groups or more (classes linked so far, `root`) are opened:
   what long prefixes have linked is not compared again below shorter ones, so the crowded nodes near the roots are settled by then.
3. An opened node is sorted by label and cut into blocks, which share one of its classes, its hub (`level`); so
   a node takes rows in proportion to its classes. At the last length, nodes of several blocks that are still not
   one group are finished (`rest_of_nodes`): the classes outside the largest group are cut into blocks, and each of these
   meets each other one and each block of the largest group, two blocks in a task. Full signatures estimate the similarity;
   pairs under `estimate` (5 standard errors below the threshold and more) go, and what stays is handed on as
   stars (group, smallest group), never as all pairs. The groups at the end are candidate clusters.
4. Exact verification: the n-gram sets of a cluster's texts meet in one task, or, for a large cluster, block by
   block; a task counts the exact intersections of its block pair and emits one row per class (its links, and a
   star), so rows grow with classes and blocks, not with pairs. No link between different texts is lost; each
   counts as many documents as its class has copies.

Words are lower-cased, split at white space. A text of one to four words has one n-gram, all its words. Defined
results: null, empty and blank texts have no n-grams: no links, a class of their own. Repeated rows are copies.
An empty table gives an empty result; other columns are ignored. Ids must be integers; rows without an id take
part and have a null doc_id in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, discard, free_name, materialise, small_batches
from barlattice.llm.components import components
from barlattice.llm.grouped import by_runs

by_value(__name__)

N = 5
SIMILARITY = 0.8
TREES = 24
DEPTH = 5
RECALL = 0.99999
#: Classes per block, and n-grams per block, of a pair of blocks that one task compares.
BLOCK = 512
BLOCK_GRAMS = 1_000_000
#: So many rows of about 50 bytes are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000

STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def recall_at(similarity: float, trees: int, depth: int) -> float:
    """How likely a pair of this similarity shares a prefix of so many minhashes in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def last_depth(similarity: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix that meets the recall."""
    while depth > 1 and recall_at(similarity, trees, depth) < recall:
        depth -= 1
    return depth


def grams(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams in text order, offsets of each text's n-grams, and two digests of each text's words."""
    start, end, of = tc.words(data, offsets)
    texts = len(offsets) - 1
    h = tc.hashes(data, start, end)
    at = np.searchsorted(of, np.arange(texts + 1))
    count = np.diff(at)
    # a word counts with its place, so that no arithmetic of the words' hashes makes two sequences alike
    place = tc.mix((np.arange(len(h)) - at[of]).astype(np.uint64) + np.uint64(1))
    sums = np.zeros((2, len(h) + 1), dtype=np.uint64)
    for k in range(2):
        np.cumsum(tc.mix((h ^ place) * (STEP + np.uint64(2 * k)) + np.uint64(k)), out=sums[k, 1:])
    digest = np.stack([tc.mix(x[at[1:]] - x[at[:-1]] + count.astype(np.uint64)) for x in sums])
    size = np.maximum(count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(size)])
    g = np.zeros(out_at[-1], dtype=np.uint64)
    if len(h) >= n:
        whole = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            whole = tc.mix(whole * STEP) + h[j : len(h) - n + 1 + j]
        inside = of[: len(whole)] == of[n - 1 :]
        long = count >= n
        g[np.repeat(long, size)] = tc.mix(whole[inside])
    for d in np.flatnonzero((count > 0) & (count < n)):
        x = count[d : d + 1].astype(np.uint64)
        for v in h[at[d] : at[d + 1]]:
            x = tc.mix(x * STEP) + v
        g[out_at[d]] = tc.mix(x)[0]
    return g, out_at, digest


def seeds(k: int) -> np.ndarray:
    return tc.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def minhash(g: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One row of uint32 minhashes for each text that has n-grams."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), len(factors)), dtype=np.uint32)
    if len(starts):
        buffer = np.empty_like(g)
        for k, a in enumerate(factors):
            np.multiply(g, a, out=buffer)
            np.right_shift(buffer, np.uint64(32), out=buffer)
            out[:, k] = np.minimum.reduceat(buffer, starts)
    return out


def lowered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tc.bytes_of(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))


SIGNED = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])


def signer(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = seeds(trees * depth)
        for batch in batches:
            for part in tc.pieces(batch, "text"):
                g, at, digest = grams(*lowered(part))
                sig = iter(minhash(g, at, factors))
                has = np.diff(at) > 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.view(np.int64)) for x in digest), pa.array([next(sig).tobytes() if x else None for x in has], type=pa.binary())], schema=SIGNED)

    return run


STAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For a boolean matrix of links, the smallest id that each row is connected to."""
    label = np.full(len(ids), -1)
    for i in range(len(ids)):
        if label[i] >= 0:
            continue
        seen, todo = np.zeros(len(ids), dtype=bool), [i]
        seen[i] = True
        while todo:
            fresh = near[todo].any(axis=0) & ~seen
            seen |= fresh
            todo = np.flatnonzero(fresh).tolist()
        label[seen] = np.flatnonzero(seen)[np.argmin(ids[seen])]
    return ids[label]


def across(block: np.ndarray, bi: int, bj: int) -> np.ndarray:
    """Which pairs of rows this pair of blocks is to compare."""
    if bi == bj:
        return ~np.eye(len(block), dtype=bool)
    return block[:, None] != block[None, :]


def agreeing(x: np.ndarray, y: np.ndarray, need: int) -> np.ndarray:
    """Which signatures of x and y have so many minhashes in common."""
    return np.stack([(y == row).sum(axis=1) >= need for row in x]) if len(x) and len(y) else np.zeros((len(x), len(y)), dtype=bool)


def estimated(estimate: float):
    """Stars of the groups that meet in a block of a node: the estimate is taken between classes of different groups, and only across where rows stand on two sides."""

    def each(t: pa.Table, a: int, b: int) -> Iterator[dict]:
        if b - a < 2:
            return
        root, side = (t.column(c).to_numpy()[a:b] for c in ("root", "side"))
        sig = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in t.column("sig").slice(a, b - a)])
        need = int(np.ceil(estimate * sig.shape[1]))
        if side.any():
            near = np.zeros((b - a, b - a), dtype=bool)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near[np.ix_(left, right)] = agreeing(sig[left], sig[right], need)
            near |= near.T
        else:
            near = agreeing(sig, sig, need)
        one = root[:, None] == root[None, :]
        near &= ~one
        if near.any():
            least = stars(near | one, root)
            moved = least != root
            yield {"a": root[moved], "b": least[moved]}

    return by_runs(["trie", "block"], each, STAR)


SETS = pa.schema([("cid", pa.int64()), ("grams", pa.binary()), ("n_grams", pa.int64())])


def setter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted set of n-grams of each text whose digests are those of its class."""
    for batch in batches:
        for part in tc.pieces(batch, "text"):
            g, at, digest = grams(*lowered(part))
            same = (digest[0].view(np.int64) == part.column("d1").to_numpy()) & (digest[1].view(np.int64) == part.column("d2").to_numpy())
            sets = [np.unique(g[at[i] : at[i + 1]]) for i in np.flatnonzero(same)]
            yield pa.RecordBatch.from_arrays([part.column("cid").filter(pa.array(same)), pa.array([x.tobytes() for x in sets], type=pa.binary()), pa.array([len(x) for x in sets], type=pa.int64())], schema=SETS)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    at, run = tc.sorted_runs(flat[order])
    shared = run > 1
    col = np.repeat(np.where(shared, np.cumsum(shared) - 1, -1), run)
    row, keep = row[order], col >= 0
    row, col = row[keep], col[keep]
    total = np.zeros((n, n), dtype=np.float64)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        total += m @ m.T
    return np.rint(total).astype(np.int64)


VERIFIED = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def verifier(similarity: float):
    def each(t: pa.Table, a: int, b: int) -> Iterator[dict]:
        ids = t.column("cid").to_numpy()[a:b]
        own = np.concatenate([[True], ids[1:] != ids[:-1]])  # a repeated row of the text comes twice
        pick = np.flatnonzero(own)
        if len(pick) < 2:
            return
        ids, block, copies = ids[pick], t.column("block").to_numpy()[a:b][pick], t.column("copies").to_numpy()[a:b][pick]
        sets = [np.frombuffer(t.column("grams")[a + int(i)].as_buffer(), dtype=np.uint64) for i in pick]
        size = np.array([len(x) for x in sets])
        both = overlaps(sets)
        either = size[:, None] + size[None, :] - both
        near = (both >= similarity * either - 1e-9) & across(block, int(t.column("bi")[a].as_py()), int(t.column("bj")[a].as_py()))
        linked = near.any(axis=1)
        if linked.any():
            yield {"cid": ids[linked], "root": stars(near, ids)[linked], "links": (near @ copies)[linked]}

    return by_runs(["node", "bi", "bj"], each, VERIFIED)


def in_blocks(rows: DataFrame, node: str, blocks: str, id_col: str) -> DataFrame:
    """Each row once for each pair of blocks that its block is in; adds node, block, bi, bj."""
    own = rows.withColumn("block", F.expr(f"pmod(xxhash64({id_col}), {blocks})"))
    own = own.withColumn("other", F.explode(F.expr(f"sequence(0L, cast({blocks} as bigint) - 1)")))
    return own.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).withColumn("node", F.col(node)).drop("other")


def grouped(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj", *order)


def nodes_of(rooted: DataFrame, trees: int, depth: int, length: int) -> DataFrame:
    """trie, cid, root: the node of every class in every tree, at prefixes of this length."""
    label = [F.xxhash64(F.lit(t), F.substring("sig", 1 + 4 * depth * t, 4 * length)) for t in range(trees)]
    return rooted.select("cid", "root", F.explode(F.array(*label)).alias("trie"))


def level(rooted: DataFrame, similarity: float, trees: int, depth: int, length: int) -> tuple[DataFrame, bool]:
    """Links between groups (a, b) of the nodes at prefixes of this length that hold two groups or more, and whether a node was too large to compare all its groups."""
    nodes = nodes_of(rooted, trees, depth, length)
    opened = nodes.groupBy("trie").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("root", "cid")).alias("hub"), F.max("root").alias("most")).where("hub.root < most")
    opened = materialise(opened.select("trie", "hub.root", "hub.cid", F.expr(f"cast(ceil(n / {BLOCK}) as bigint)").alias("blocks")), "opened")
    cut = not opened.where("blocks > 1").isEmpty()
    own = nodes.join(opened.select("trie", "blocks", F.col("cid").alias("hub")), "trie").where("blocks = 1 or cid <> hub").select("trie", F.expr("pmod(xxhash64(cid), blocks)").alias("block"), "cid", "root", F.lit(0).alias("side"))
    hubs = opened.where("blocks > 1").select("trie", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "cid", "root", F.lit(0).alias("side"))
    return estimated_links(own.union(hubs), rooted, similarity), cut


def rest_of_nodes(rooted: DataFrame, similarity: float, trees: int, depth: int, length: int) -> DataFrame:
    """Links between the groups of nodes of several blocks. No task gets more than two blocks of a node (hashes fill them, so a block has BLOCK classes give or take a few deviations)."""
    nodes = nodes_of(rooted, trees, depth, length)
    return estimated_links(block_pairs(nodes), rooted, similarity)


def block_pairs(nodes: DataFrame) -> DataFrame:
    """trie, block, cid, root, side: the classes outside a node's largest group, and those inside, in blocks; a pair of blocks is a block of the result, and its sides are the two. nodes: trie, cid, root."""
    sizes = nodes.groupBy("trie", "root").agg(F.count(F.lit(1)).alias("n"))
    opened = sizes.groupBy("trie").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("groups")).where(f"groups > 1 and n > {BLOCK}")
    opened = materialise(opened.select("trie", F.col("top.root").alias("top"), F.expr(f"cast(ceil((n - top.n) / {BLOCK}) as bigint)").alias("outer"), F.expr(f"cast(ceil(top.n / {BLOCK}) as bigint)").alias("inner")), "unfinished")
    members = nodes.join(opened, "trie")
    outside = members.where("root <> top").withColumn("own", F.expr("pmod(xxhash64(cid), outer)"))
    inside = members.where("root = top").withColumn("own", F.expr("pmod(xxhash64(cid), inner)"))
    # a pair of outer blocks i <= j is block i * outer + j, of an outer block i and an inner block j the block outer * outer + i * inner + j
    other = outside.withColumn("other", F.explode(F.expr("sequence(0L, outer - 1)")))
    met = other.select("trie", F.expr("least(own, other) * outer + greatest(own, other)").alias("block"), "cid", "root", F.expr("if(own > other, 1, 0)").alias("side"))
    left = outside.withColumn("other", F.explode(F.expr("sequence(0L, inner - 1)"))).select("trie", F.expr("outer * outer + own * inner + other").alias("block"), "cid", "root", F.lit(0).alias("side"))
    right = inside.withColumn("other", F.explode(F.expr("sequence(0L, outer - 1)"))).select("trie", F.expr("outer * outer + other * inner + own").alias("block"), "cid", "root", F.lit(1).alias("side"))
    return met.union(left).union(right)


def estimated_links(members: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame:
    """a, b of the groups that the estimate links. members: trie, block, cid, root, side."""
    signed = members.join(rooted.select("cid", "sig"), "cid").select("trie", "block", "cid", "root", "side", "sig")
    placed = signed.repartition("trie", "block").sortWithinPartitions("trie", "block", "cid")
    return placed.mapInArrow(estimated(similarity - 0.2), "a long, b long")


def forest(classes: DataFrame, similarity: float, trees: int, depth: int, recall: float) -> DataFrame:
    """cid, sig, root: the classes with their groups, when prefixes have been shortened until the recall. classes: cid, sig."""
    rooted = classes.withColumn("root", F.col("cid"))
    last = last_depth(similarity, recall, trees, depth)
    steps = [*range(depth, last - 1, -1), 0]
    for length in steps:
        if length:
            links, cut = level(rooted, similarity, trees, depth, length)
        elif cut:
            links = rest_of_nodes(rooted, similarity, trees, depth, last)
        else:
            break
        moves = components(links)
        before = rooted
        rooted = rooted.join(moves.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        rooted = materialise(rooted.select("cid", "sig", F.coalesce("to", "root").alias("root")), "rooted")
        if length != depth:
            discard(before)
    return rooted


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id it is linked to over any number of links), n_links (documents at the similarity or more), n_copies, copy_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(texts.mapInArrow(signer(trees, depth), "doc_id long, d1 long, d2 long, sig binary"), "signed")
    classes = signed.where("sig is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    rooted = forest(classes.select("cid", "sig"), similarity, trees, depth, recall)
    linked = rooted.where("root <> cid")
    clusters = materialise(linked.select("cid", F.col("root").alias("cluster")).union(linked.select(F.col("root").alias("cid"), F.col("root").alias("cluster")).distinct()), "clusters")

    wanted = clusters.join(classes.select("cid", "rep", "d1", "d2"), "cid").select("cid", F.col("rep").alias("doc_id"), "d1", "d2")
    wanted = materialise(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("cid", "d1", "d2", "text")
    sets = materialise(found.mapInArrow(setter, "cid long, grams binary, n_grams long"), "sets")
    sized = clusters.join(sets.select("cid", "n_grams").distinct(), "cid").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    # clusters of one block need no lookup; those of several are few (classes / BLOCK and n-grams / BLOCK_GRAMS at most)
    large = materialise(sized.where(f"n > {BLOCK} or g > {BLOCK_GRAMS}").select("cluster", F.expr(f"cast(greatest(ceil(n / {BLOCK}), ceil(g / {BLOCK_GRAMS})) as bigint)").alias("blocks")), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    rows = clusters.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.join(classes.select("cid", "copies"), "cid").join(sets.select("cid", "grams"), "cid")
    verified = grouped(in_blocks(rows, "cluster", "blocks", "cid").select("node", "bi", "bj", "block", "cid", "copies", "grams"), "cid").mapInArrow(verifier(similarity), "cid long, root long, links long")
    verified = materialise(verified, "verified")
    discard(sets)

    links = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(verified.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    names = linked.join(classes.select("cid", "rep"), "cid")
    roots = names.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_class = classes.select("cid", "d1", "d2", "rep", "copies").join(names.select("cid", "root").join(roots, "root").drop("root"), "cid", "left").join(links, "cid", "left")
    per_class = materialise(per_class.select("d1", "d2", F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")), "perclass")
    own = signed.select("doc_id", "d1", "d2", F.col("sig").isNotNull().alias("has"))
    plain = own.where("not has").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("doc_id").alias("copy_id"))
    full = own.where("has").join(per_class, ["d1", "d2"]).select("doc_id", "class_id", "n_links", "n_copies", "copy_id")
    return full.unionByName(plain)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, without those that are linked to a document with a smaller id (rows without an id stay)."""
    name = free_name(docs, "x_gone")
    gone = materialise(near_classes(docs, id_col, text_col, **how).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    small = gone.count() <= 4 * BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, F.col(id_col) == F.col(name), "left_anti")
