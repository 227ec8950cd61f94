import collections

from barlattice.llm import blocks, common


def test_buckets_grow_with_the_files(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    assert blocks.bucket_count(stored) == 8 and blocks.bucket_count(docs) == max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 2000)
    assert blocks.bucket_count(stored) > 20


def test_blocks_hold_every_text_once(docs, made):
    table, size = blocks.make_blocks(docs, block_bytes=5000)
    assert size == sum(len((t or "").encode()) for _, t, *_ in made)
    ids = collections.Counter(i for r in table.select("ids").collect() for i in r["ids"])
    assert ids == collections.Counter(i for i, *_ in made)


def test_batches_are_bounded_only_where_they_are_not(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1000000")
    common.small_batches(spark)
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)
    common.small_batches(spark)
    assert int(spark.conf.get(key)) == common.BATCH_BYTES
