"""Many needles in many texts: which texts hold which strings, without a text for each needle or gram.

1. Every needle names one of its six-byte grams, the one that the fewest needles have; needles shorter than that are
   grams themselves. A bitmap of fixed size says which grams are asked for.
2. Texts are read once and yield (doc_id, gram), each gram once, for the grams in the bitmap only.
3. Needles meet those pairs by gram. What comes out are candidates: ids and needles, no text.
4. Each text with a candidate is fetched once by its id and searched for them; needles of up to six bytes need no look.
5. Needles that were found become the codes that have them: a needle of many codes is looked for once.

Only step 4 shuffles texts, and only if the candidates are too many to broadcast. UTF-8 is self-synchronising, so bytes may stand for characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.scratch import by_value, stored

by_value(__name__)

GRAM = 6
#: Slots of the bitmap, a prime.
SLOTS = 1_048_573
#: So many candidates, of ids and needles, are broadcast to the texts; beyond, both are shuffled by id.
BROADCAST_ROWS = 200_000


def asked(needles: DataFrame) -> DataFrame:
    """code, needle, gram (a number: length of the gram, then its bytes) of every needle. needles: code, needle, not empty."""
    raw = F.encode("needle", "UTF-8")
    number = lambda x: F.conv(F.hex(x), 16, 10).cast("long") + F.shiftleft(F.octet_length(x).cast("long"), 48)
    last = F.greatest(F.octet_length("needle") - (GRAM - 1), F.lit(1))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: number(F.substr(raw, i, F.lit(GRAM)))))
    each = needles.select("code", "needle", F.explode(grams).alias("gram"))
    rare = each.join(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").groupBy("code", "needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return stored(rare, "needles")


def bitmap(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which slots hold a gram that is asked for, and the lengths of such grams; the driver gets SLOTS bits, whatever the needles."""
    slot = F.expr(f"pmod(gram, {SLOTS}L) + 1")  # positions count from 1
    rows = grams.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(SLOTS + 32_768, dtype=bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
        at = (r["k"] - 1) * 32_768
        out[at : at + len(bits)] |= bits.astype(bool)[: len(out) - at]
    return out[:SLOTS], sorted(r[0] for r in grams.select(F.shiftright("gram", 48)).distinct().collect())


PAIRS = pa.schema([("doc_id", pa.int64()), ("gram", pa.int64())])


def grams_of(wanted: np.ndarray, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            ids, grams = [], []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                data = np.frombuffer(text[i].as_buffer(), dtype=np.uint8).astype(np.int64)
                value = np.zeros(len(data), dtype=np.int64)
                found = []
                for n in range(1, GRAM + 1):
                    if len(data) < n:
                        break
                    value = (value[: len(data) - n + 1] << 8) | data[n - 1 :]
                    if n in lengths:
                        key = value + (n << 48)
                        found.append(np.unique(key[wanted[key % SLOTS]]))
                found = np.concatenate(found) if found else value[:0]
                grams.append(found)
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(np.concatenate(grams) if grams else [], type=pa.int64())], schema=PAIRS)

    return run


def candidates(texts: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id, code, needle of the texts that hold a needle's gram."""
    found = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(grams_of(*bitmap(rare)), "doc_id long, gram long")
    return found.join(rare, "gram").select("doc_id", "code", "needle")


def find(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """doc_id, code: which texts hold a needle of which code; null and empty needles and texts hold nothing. texts: doc_id, text; needles: code, needle."""
    named = stored(needles.where("needle IS NOT NULL AND needle <> ''").select("code", "needle").distinct(), "named")
    each = named.groupBy("needle").agg(F.min("code").alias("code"))  # one of its codes, the others come at the end
    met = stored(candidates(texts, asked(each)).select("doc_id", "needle"), "candidates")
    short = F.octet_length("needle") <= GRAM
    long = met.where(~short).groupBy("doc_id").agg(F.collect_set("needle").alias("needles")).select(F.col("doc_id").alias("_doc"), "needles")
    long = F.broadcast(long) if met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else long
    looked = texts.join(long, F.col("doc_id").eqNullSafe(F.col("_doc"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.filter("needles", lambda n: F.contains("text", n))).alias("needle"))
    held = met.where(short).union(looked).join(named, "needle")
    return held.select("doc_id", "code").distinct()
