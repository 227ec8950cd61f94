"""Token counts without token ids: every distinct pre-token is counted once, and documents add up their pre-tokens.

1. Blocks of some MB of text are cut into pre-tokens (`cuts`): pre-tokens cover a text without gaps, so they are its bytes
   between cuts, and an exact dictionary of the block gives each a number. A block yields its dictionary, a row per distinct
   pre-token, and one packed row that says how often each of its documents has which number.
2. The dictionaries' rows meet by pre-token, in order: each distinct pre-token of the corpus is counted once by the
   tokenizer's own model, and its count goes to all of its rows (`counter`). A frequent pre-token has a row per block there, not per
   occurrence or document; a task streams them and keeps one pre-token. No text moves.
3. The counts go back to their blocks, packed, and each document sums frequency x pieces. Ids never exist.

Where cuts go depends on classes of characters (letter, number, white space, other) as the tokenizer's library has them; each
character beyond ASCII is asked for once per worker. The places of special strings are cut first, as the library does.
This holds for byte-level BPE with the usual pattern and no normaliser; other tokenizers are refused when loaded.

Defined results: null and empty texts have no tokens and no bytes. Repeated rows and ids are fine, ids may be null (they are cast to
long); an empty table gives an empty result. Long texts are counted whole; a text longer than a block is a block of its own. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, materialise, small_batches
from barlattice.llm.grouped import runs

by_value(__name__)

MODEL = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
#: Bytes of text that share a dictionary.
BLOCK_BYTES = 16 << 20
LETTER, NUMBER, BLANK, OTHER = range(4)
#: What may follow an apostrophe as a pre-token of its own, by length.
SHORT_FORMS = {1: (b"s", b"t", b"m", b"d"), 2: (b"re", b"ve", b"ll")}


class Model:
    """The tokenizer's library, asked for classes of characters and for pieces of single pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} is no byte-level BPE with the usual pattern")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special strings that depend on what surrounds them")
        #: Of two special strings that start at one place the longer wins.
        self.special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.tokenizer = Tokenizer.from_file(path)
        self.classes = np.full(0x110000, 255, dtype=np.uint8)
        self.classify(np.arange(128))

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The class of each character: a letter joins a letter, a number a number, and so on."""
        for p in np.unique(points[self.classes[points] == 255]):
            joins = lambda x: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + chr(p))) == 1  # noqa: B023, E731
            self.classes[p] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins(".") else BLANK
        return self.classes[points]

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 data starts, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.int64)
    wide = np.flatnonzero(point >= 0x80)
    if len(wide):
        lead = point[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            value[more] = (value[more] << 6) | (data[at[wide[more]] + k] & 0x3F)
        point[wide] = value
    return at, point


def special_spans(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> list[tuple[int, int]]:
    """Where special strings stand inside the texts, from left to right."""
    raw, out, floor = data.tobytes(), [], 0
    found = sorted((at, -len(s)) for s in special for at in places(raw, s))
    for at, size in found:
        text = int(np.searchsorted(offsets, at, side="right")) - 1
        if at >= floor and at - size <= offsets[text + 1]:
            out.append((at, at - size))
            floor = at - size
    return out


def places(raw: bytes, wanted: bytes) -> Iterator[int]:
    at = raw.find(wanted)
    while at >= 0:
        yield at
        at = raw.find(wanted, at + 1)


def cuts(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Where pre-tokens start, in bytes. A pre-token is a short form after an apostrophe, or a run of letters, numbers or others with
    one space before it, or a run of white space without its last character where something follows, or that character."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    spans = special_spans(data, offsets, model.special)
    at, point = characters(data)
    kind = model.classify(point)
    n = len(at)
    fresh = np.zeros(n + 1, dtype=bool)  # texts and special strings start and end here
    fresh[np.searchsorted(at, offsets)] = True
    inside = np.zeros(n, dtype=bool)
    for a, b in spans:
        i, j = np.searchsorted(at, [a, b])
        fresh[[i, j]] = True
        inside[i + 1 : j] = True
    fresh[n] = True
    turn = fresh[:n].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    space_before = np.zeros(n, dtype=bool)
    space_before[1:] = (point[:-1] == 32) & ~fresh[1:n]
    start = turn & (blank | ~space_before)
    follows = np.zeros(n, dtype=bool)  # the last of a run of white space, with something after it
    follows[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:n]
    start |= follows
    quote = np.flatnonzero(turn & (point == 39) & ~space_before)
    if len(quote):
        stop = np.flatnonzero(fresh)
        room = stop[np.searchsorted(stop, quote, side="right")] - quote - 1
        for size, forms in SHORT_FORMS.items():
            here = quote[room >= size]
            hit = np.zeros(len(here), dtype=bool)
            for form in forms:
                hit |= np.logical_and.reduce([point[here + 1 + k] == c for k, c in enumerate(form)])
            here = here[hit]
            start[here + 1] = False
            after = here + 1 + size
            start[after[after < n]] = True
    start &= ~inside
    return at[start]


def packed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), dtype=kind)


BLOCKS = pa.schema([("block", pa.int64()), ("number", pa.int64()), ("token", pa.string()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ends", pa.binary()), ("numbers", pa.binary()), ("times", pa.binary())])


def block_rows(parts: list[pa.RecordBatch], block: int, model: Model) -> Iterator[pa.RecordBatch]:
    """The dictionary of a block, and a row with number -1 that says which text has which pre-token how often."""
    table = pa.Table.from_batches(parts).combine_chunks()
    data, offsets = tc.bytes_of(table.column("text").combine_chunks())
    start = []
    for a in range(0, len(offsets) - 1):
        if a == 0 or offsets[a + 1] - offsets[low] > tc.PIECE:  # noqa: F821
            if a:
                start.append(cuts(data[offsets[low] : offsets[a]], offsets[low : a + 1] - offsets[low], model) + offsets[low])  # noqa: F821
            low = a
    start.append(cuts(data[offsets[low] :], offsets[low:] - offsets[low], model) + offsets[low])
    begin = np.concatenate(start)
    bounds = np.append(begin, len(data)).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    # neighbours of a sorted dictionary share their beginnings, which compresses well
    order = pc.array_sort_indices(tokens.dictionary).to_numpy()
    known = tokens.dictionary.take(pa.array(order))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    of = np.searchsorted(offsets, begin, side="right") - 1
    key, times = np.unique(of * max(1, len(known)) + place[tokens.indices.to_numpy()], return_counts=True)
    of, number = key // max(1, len(known)), key % max(1, len(known))
    step = number.copy()
    step[1:] -= np.where(of[1:] == of[:-1], number[:-1], 0)
    none = [pa.nulls(1, f.type) for f in BLOCKS]
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([-1]), none[2], pa.array([table.column("doc_id").to_pylist()], type=BLOCKS.field("ids").type), pa.array([np.diff(offsets)], type=BLOCKS.field("sizes").type),
         pa.array([packed(np.searchsorted(of, np.arange(1, len(offsets))).astype(np.int32))]), pa.array([packed(step.astype(np.uint32))]), pa.array([packed(times.astype(np.uint32))])], schema=BLOCKS)
    for a in range(0, len(known), 1 << 16):
        some = known.slice(a, 1 << 16)
        rest = [pa.nulls(len(some), f.type) for f in BLOCKS][3:]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(np.arange(a, a + len(some))), some.cast(pa.string()), *rest], schema=BLOCKS)


def blocker(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block, parts, held = Model(path), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in tc.pieces(batch, "text"):
                length = len(tc.bytes_of(part.column("text"))[0])
                if parts and held + length > size:
                    yield from block_rows(parts, block, model)
                    block, parts, held = block + 1, [], 0
                parts.append(part)
                held += length
        if parts:
            yield from block_rows(parts, block, model)

    return run


COUNTED = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ends", pa.binary()), ("numbers", pa.binary()), ("times", pa.binary())])
#: Rows that a task holds before it packs them by block.
HELD = 1 << 20


def counted_rows(block: np.ndarray, number: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """A row per block: the numbers, as steps, and what each counts."""
    order = np.lexsort((number, block))
    block, number, pieces = block[order], number[order], pieces[order]
    at, run = tc.sorted_runs(block)
    rows = [(packed(np.diff(number[a : a + n], prepend=0).astype(np.uint32)), packed(pieces[a : a + n].astype(np.uint32))) for a, n in zip(at, run, strict=True)]
    none = [pa.nulls(len(at), f.type) for f in COUNTED]
    return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(np.ones(len(at), dtype=np.int64)), none[2], none[3], none[4], pa.array([n for n, _ in rows], type=pa.binary()), pa.array([p for _, p in rows], type=pa.binary())], schema=COUNTED)


def counter(path: str):
    """Rows sorted by pre-token to packed counts by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, known, parts, held = Model(path), None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs_of = batch.column("token").dictionary_encode()
            tokens = runs_of.dictionary.to_pylist()
            skip = int(tokens[0] == last)
            pieces = [known] * skip + model.pieces(tokens[skip:])
            last, known = tokens[-1], pieces[-1]
            parts.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), np.array(pieces)[runs_of.indices.to_numpy()]))
            held += batch.num_rows
            if held >= HELD:
                yield counted_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts, held = [], 0
        if parts:
            yield counted_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


SUMS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of frequency x pieces for each text of a block; of a block's rows the one with its texts (kind 0) comes first."""
    for t, bounds in runs(batches, ["block"]):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ends, step, times = (unpacked(t.column(c)[a].as_py(), k).astype(np.int64) for c, k in (("ends", np.int32), ("numbers", np.uint32), ("times", np.uint32)))
            # steps start again in each text
            walk = np.concatenate([[0], np.cumsum(step)])
            begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            number = walk[1:] - np.repeat(walk[begin], ends - begin)
            pieces = np.zeros(int(number.max()) + 1 if len(number) else 0, dtype=np.int64)
            for k in range(a + 1, b):
                pieces[np.cumsum(unpacked(t.column("numbers")[k].as_py(), np.uint32).astype(np.int64))] = unpacked(t.column("times")[k].as_py(), np.uint32)
            sums = np.concatenate([[0], np.cumsum(pieces[number] * times)])
            yield pa.RecordBatch.from_arrays([t.column("ids")[a].values, t.column("sizes")[a].values, pa.array(sums[ends] - sums[begin])], schema=SUMS)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    small_batches(docs.sparkSession)
    Model(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "block long, number long, token string, ids array<long>, sizes array<long>, ends binary, numbers binary, times binary"
    blocks = materialise(rows.mapInArrow(blocker(path, block_bytes), schema), "pretokens", "zstd")
    entries = blocks.where("number >= 0").select("block", "number", "token").repartition("token").sortWithinPartitions("token")
    counted = entries.mapInArrow(counter(path), "block long, kind long, ids array<long>, sizes array<long>, ends binary, numbers binary, times binary")
    texts = blocks.where("number = -1").select("block", F.lit(0).cast("long").alias("kind"), "ids", "sizes", "ends", "numbers", "times")
    placed = texts.unionByName(counted).repartition("block").sortWithinPartitions("block", "kind")
    sums = placed.mapInArrow(summer, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
