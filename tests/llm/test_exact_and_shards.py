import collections
import hashlib
import string

from barlattice.llm import exact_dedup, sharding

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256((text or "").translate(LOW).encode()).hexdigest()


def test_mark_copies(docs, made, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in made:
        groups[sha(t)].append(i)
    want = collections.Counter()
    for i, t, *_ in made:
        g = groups[sha(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[(i, keep, len(g), i == keep, sha(t))] += 1
    got = collections.Counter(tuple(r) for r in exact_dedup.mark_copies(docs).collect())
    assert got == want
    assert exact_dedup.mark_copies(empty).count() == 0


def test_a_small_summary_gives_the_same(docs):
    whole = collections.Counter(tuple(r) for r in exact_dedup.mark_copies(docs).collect())
    assert whole == collections.Counter(tuple(r) for r in exact_dedup.mark_copies(docs, heavy_items=2, tracked=8).collect())


def test_drop_copies_keeps_one_row_of_each_text(docs, made, empty):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert len(rows) == len({sha(r["text"]) for r in rows}) == len({sha(t) for _, t, *_ in made})
    assert exact_dedup.drop_copies(empty).count() == 0


def test_drop_copies_by_shuffles(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.drop_copies(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_dedup.drop_copies(docs).collect())) == want


def test_shards_fit_and_only_large_buckets_split(docs, made, empty, spark, tmp_path):
    limit = 6000
    rows = sharding.assign_shards(docs, limit).collect()
    assert len(rows) == len(made)
    size, ids = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r["shard_id"]] += r["doc_bytes"]
        ids[r["shard_id"]].append(r)
        assert len(r["shard_id"]) == r["shard_depth"]
    for shard, own in ids.items():
        assert {r["shard_bytes"] for r in own} == {size[shard]} and {r["shard_docs"] for r in own} == {len(own)}
        assert size[shard] <= limit or len({(r["doc_id"]) for r in own}) == 1
        assert all(r["oversized"] == (size[shard] > limit) for r in own)
        if shard:  # the bucket it was split from was too large
            assert sum(n for s, n in size.items() if s.startswith(shard[:-1])) > limit
        assert not any(s != shard and s.startswith(shard) for s in size)
    assert sharding.assign_shards(empty).count() == 0
    assert {r["shard_id"] for r in sharding.assign_shards(docs, 1 << 40).collect()} == {""}
    sharding.write_shards(docs.withColumnRenamed("block", "shard"), str(tmp_path / "out"), limit)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(made)


def test_a_crowded_slot_is_split_alone(spark):
    """3,000 keys that differ in their last 20 bits only, beside 3,000 spread ones: the directory has few slots more than one that never saw them."""
    import random

    rnd = random.Random(3)
    spread = [(rnd.getrandbits(60), 10) for _ in range(3000)]
    near = [((5 << 57) | rnd.getrandbits(20), 10) for _ in range(3000)]
    keys = lambda rows: spark.createDataFrame(rows, "h long, doc_bytes long")
    slots, levels = sharding.directory(keys(spread + near), 1000)
    assert len(levels) > 8 and slots.count() < sharding.directory(keys(spread), 1000)[0].count() + 1000
    rows = sharding.located(keys(spread + near).withColumn("bits", sharding.F.lit(7)).drop("bits"), "h", slots, levels).collect()
    assert len(rows) == 6000
    size = collections.Counter((r["depth"], r["prefix"]) for r in rows)
    assert all(r["prefix"] == r["h"] >> (60 - r["depth"]) and r["shard_docs"] == size[r["depth"], r["prefix"]] <= 100 for r in rows)
