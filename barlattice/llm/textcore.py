"""Vectorised work on the bytes of many texts at once: offsets, words, hashes.

`hashes` is for keys that decide results: it mixes after every eight bytes, so no algebra of the bytes is left in it.
`Rolling` is a polynomial modulo 2**64, which structured texts (Thue-Morse words) can fool; it serves filters and statistics only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barlattice.llm.common import by_value

by_value(__name__)

#: Multiplier of the polynomial hash, odd and 3 modulo 4, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C17
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


CODES = byte_codes()
#: The white space of [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z, leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """BASE**i and BASE**-i modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up, self.down


class Rolling:
    """Hashes of any byte range of data: equal for equal bytes, wherever they stand."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        self.up, down = powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(CODES[data] * down[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.up[start]
        return mix(x + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros beyond the end."""
    raw = data.tobytes() + b"\0" * 8
    return np.ndarray((len(data),), dtype=f"{order}u8", buffer=raw, strides=(1,)) if len(data) else np.zeros(0, dtype=np.uint64)


#: Byte ranges beyond this length are hashed one by one.
LONG = 256


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each range, eight bytes at a time."""
    gram, size = eights(data), end - start
    h = mix(size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    active, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(active):
        x = gram[start[active] + done]
        left = size[active] - done
        cut = left < 8
        x[cut] &= (np.uint64(1) << (np.uint64(8) * left[cut].astype(np.uint64))) - np.uint64(1)
        h[active] = mix((h[active] ^ x) * np.uint64(0xD6E8FEB86659FD93))
        done += 8
        active = active[left > 8]
    for k in np.flatnonzero(size > LONG):
        h[k] = np.frombuffer(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
    return h


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_large_binary(column.type) else "", column.type))
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about limit bytes of text each."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word: [^\\x20\\x09-\\x0D]+, or runs of the bytes that inside says."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = ~SPACE[data] if inside is None else inside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = solid[tails]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts)


def sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal values of a sorted array, and the lengths."""
    if not len(keys):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return at, np.diff(np.append(at, len(keys)))
