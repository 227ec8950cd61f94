"""Counting keys of the whole corpus, and telling every text the counts of its own keys, in packed form.

Documents are packed into blocks of some MB of text, one row each, in a table bucketed by block: later joins by
block leave the texts where they are. A round of `exchange`:

* every block sends its sorted distinct 64-bit keys with counts, cut by leading bits into one packed row per bucket
  (map-side pre-aggregation: a key goes once per block, however often it occurs);
* every bucket, a bounded share of the key space, merges the rows of all blocks by sorting and answers each block
  with one packed row, in the block's own key order.

A frequent key costs one entry per block, so no task is hot. Keys are hashes of 64 bits; the rows a task holds are
bounded by the block size and by the keys in a bucket, whose number grows with the corpus.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, materialise, scratch_path, small_batches
from barlattice.llm.grouped import by_runs

by_value(__name__)

BLOCK_BYTES = 4 << 20
KEYS_PER_BUCKET = 1_500_000
#: Text that one bucket of the table holds, about; how many times larger text is than its files; Spark's own limit of buckets.
BUCKET_BYTES, PACKED, MOST_BUCKETS = 8 << 20, 2, 100_000

BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("offsets", pa.binary()), ("data", pa.binary()), ("n_bytes", pa.int64())])


def blocker(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            whole = pa.ListArray.from_arrays(pa.array([0, len(own)], type=pa.int32()), own)
            return pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), whole, pa.array([offsets.tobytes()], type=pa.binary()), pa.array([np.concatenate(parts).tobytes()], type=pa.binary()), pa.array([held], type=pa.int64())], schema=BLOCKS)

        for batch in batches:
            for part in tc.pieces(batch, "text", block_bytes // 8):
                data, offsets = tc.bytes_of(part.column("text"))
                if held and held + len(data) > block_bytes:
                    yield block()
                    number, ids, parts, sizes, held = number + 1, [], [], [], 0
                ids.append(part.column("doc_id"))
                parts.append(data.copy())
                sizes.append(np.diff(offsets))
                held += len(data)
        if ids:
            yield block()

    return run


def bucket_count(docs: DataFrame) -> int:
    """So many buckets that each has about BUCKET_BYTES of text, by the size of the input's files; as many as shuffles have partitions where the input is no table of files."""
    spark = docs.sparkSession
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    by_files = math.ceil(PACKED * stored / BUCKET_BYTES) if stored < 1 << 56 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(8, by_files))


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Table of blocks: block, ids, offsets, data, n_bytes; and the bytes of all texts. Null text counts as empty. The table lives in the shared folder; its buckets grow with the input (`bucket_count`)."""
    spark = docs.sparkSession
    buckets = buckets or bucket_count(docs)
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = texts.mapInArrow(blocker(block_bytes), "block long, ids array<long>, offsets binary, data binary, n_bytes long")
    name = f"blocks_{uuid.uuid4().hex}"
    packed.write.bucketBy(buckets, "block").option("path", scratch_path(spark, "blocks")).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    return table, int(table.agg(F.sum("n_bytes")).first()[0] or 0)


def docs_of(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block's documents."""
    return row["ids"], np.frombuffer(row["data"], dtype=np.uint8), np.frombuffer(row["offsets"], dtype=np.int64)


def rows_of(batch: pa.RecordBatch, replies: int) -> Iterator[dict]:
    for k in range(batch.num_rows):
        row = {n: batch.column(n)[k] for n in batch.schema.names}
        got = []
        for r in range(replies):
            cells = row[f"r{r}"].values
            got.append([] if cells is None else [c.as_buffer() for c in cells.field("reply")])
        yield {"block": row["block"].as_py(), "ids": row["ids"].values, "data": row["data"].as_buffer(), "offsets": row["offsets"].as_buffer(), "replies": got}


def pieces_of(data: np.ndarray, offsets: np.ndarray, limit: int = tc.PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document, bytes and offsets of parts of a block."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys that share their first bits: six bytes each where there are many."""
    if len(keys) < 4096 or bits > 12:
        return b"\0" + keys.tobytes()
    high = ((keys << np.uint64(bits)) >> np.uint64(bits + 48)) if bits else keys >> np.uint64(48)
    counts = np.bincount(high.astype(np.int64), minlength=1 << (16 - bits)).astype(np.uint32)
    return b"\1" + counts.tobytes() + keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_keys(raw: bytes, bits: int, bucket: int) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, dtype=np.uint64, offset=1)
    width = 1 << (16 - bits)
    counts = np.frombuffer(raw, dtype=np.uint32, count=width, offset=1)
    low = np.frombuffer(raw, dtype=np.uint8, offset=1 + 4 * width).reshape(-1, 6)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :6] = low
    keys = out.view(np.uint64).ravel()
    keys |= np.repeat(np.arange(width, dtype=np.uint64), counts) << np.uint64(48)
    return keys | np.uint64((bucket << (64 - bits)) if bits else 0)


def pack_counts(x: np.ndarray) -> bytes:
    """Small numbers as bytes; 255 and more as 255 and four bytes at the end."""
    big = x >= 255
    return np.uint32(len(x)).tobytes() + np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype(np.uint32).tobytes()


def unpack_counts(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    (n,) = np.frombuffer(raw, dtype=np.uint32, count=1, offset=at)
    small = np.frombuffer(raw, dtype=np.uint8, count=int(n), offset=at + 4)
    big = np.flatnonzero(small == 255)
    out = small.astype(np.uint32)
    end = at + 4 + int(n)
    if len(big):
        out[big] = np.frombuffer(raw[end : end + 4 * len(big)], dtype=np.uint32)
    return out, end + 4 * len(big)


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
REPLIES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary()), ("types", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def sender(keys_of: Callable[[dict], tuple], replies: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch, replies):
                keys, first, second = keys_of(row)
                if not len(keys):
                    continue
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
                at, run_of = tc.sorted_runs(bucket)
                cells = [(int(bucket[a]), pack_keys(keys[a : a + n], bits), pack_counts(first[a : a + n]) + pack_counts(second[a : a + n])) for a, n in zip(at, run_of, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], type=pa.int32()), pa.array([row["block"]] * len(cells), type=pa.int64()), pa.array([c[1] for c in cells], type=pa.binary()), pa.array([c[2] for c in cells], type=pa.binary())], schema=SENT)

    return run


def merger(answer: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes], bits: int):
    """answer(first, second, is_first_block) of a block's keys, with the totals over all blocks."""

    def each(t: pa.Table, a: int, b: int) -> Iterator[dict]:
        bucket = int(t.column("bucket")[a].as_py())
        keys, first, second = [], [], []
        for k in range(a, b):
            keys.append(unpack_keys(t.column("keys")[k].as_buffer(), bits, bucket))
            raw = t.column("counts")[k].as_buffer()
            x, at = unpack_counts(raw)
            first.append(x)
            second.append(unpack_counts(raw, at)[0])
        size = [len(x) for x in keys]
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat, kind="stable")
        at, run_of = tc.sorted_runs(flat[order])
        sums = [np.add.reduceat(np.concatenate(x).astype(np.int64)[order], at) for x in (first, second)]
        del flat, first, second
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.repeat(np.arange(len(at)), run_of)
        lead = np.zeros(len(order), dtype=bool)
        lead[order[at]] = True
        end = 0
        for k, n in zip(range(a, b), size, strict=True):
            part = where[end : end + n]
            reply = answer(sums[0][part], sums[1][part], lead[end : end + n])
            end += n
            tell = k == a
            yield {"block": [t.column("block")[k].as_py()], "bucket": [bucket], "reply": [reply], "types": [int((sums[0] + sums[1] > 0).sum()) if tell else 0], "first": [int(sums[0].sum()) if tell else 0], "second": [int(sums[1].sum()) if tell else 0]}

    return by_runs(["bucket"], each, REPLIES, rows=64)


def bits_for(keys: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, keys / KEYS_PER_BUCKET))))


def exchange(blocks: DataFrame, keys_of: Callable[[dict], tuple], answer: Callable, expected_keys: float, replies: int = 0) -> DataFrame:
    """One round: block, bucket, reply, and types, first, second (of the bucket, on one row of it). blocks has r0.. as `attach` adds them."""
    bits = bits_for(expected_keys)
    sent = blocks.mapInArrow(sender(keys_of, replies, bits), "bucket int, block long, keys binary, counts binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "block")
    return materialise(dealt.mapInArrow(merger(answer, bits), "block long, bucket int, reply binary, types long, first long, second long"), "replies")


def attach(blocks: DataFrame, *rounds: DataFrame) -> DataFrame:
    """The blocks with an array r0, r1.. of each round's replies, in order of the buckets."""
    out = blocks
    for k, r in enumerate(rounds):
        own = r.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias(f"r{k}"))
        out = out.join(own, "block", "left")
    return out
