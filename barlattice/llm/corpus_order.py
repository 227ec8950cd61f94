"""Prefix-free parsing of a share of the corpus: suffix arrays of its dictionary and its parse, combined into the order of its suffixes.

Triggers (places whose next eight bytes hash below a bound) cut the strings into phrases. A phrase reaches over the
eight bytes of the next trigger, so no suffix of a phrase that is longer than a trigger is a proper prefix of another
(but for those that end where their string ends, and those sort first, as they should). Hence:

* the order of two suffixes of the strings is that of their phrase suffixes and, where these are equal, that of what
  follows in the parse;
* the suffix array of the dictionary (the distinct phrases, so what repeats is sorted once) gives the first, the
  suffix array of the parse (one symbol per phrase: its place in the dictionary's order) the second.

Both arrays are built by prefix doubling that sorts only what still ties. Suffixes that agree on `limit` bytes may stand in any order.
"""

from __future__ import annotations

import numpy as np

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value

by_value(__name__)

GRAM = 8


def triggers(data: np.ndarray, offsets: np.ndarray, phrase: int) -> np.ndarray:
    """Places whose next eight bytes, all in one text, hash below the bound."""
    x = tc.eights(data) * np.uint64(0xE7037ED1A0B428DB)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x8EBC6AF09C88C6E3)
    at = np.flatnonzero(x < np.uint64((1 << 64) // phrase))
    end = offsets[np.searchsorted(offsets, at, side="right")] if len(at) else at
    return at[at + GRAM <= end]


def ranks(keys: np.ndarray) -> np.ndarray:
    """How many keys are smaller, for each."""
    order = np.argsort(keys)
    at, run = tc.sorted_runs(keys[order])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(at, run)
    return out


def tied(rank: np.ndarray) -> np.ndarray:
    """Places whose rank others have too."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def refine(rank: np.ndarray, active: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Sort the ties of rank at the active places (all members of each tie) by minor; returns the places that tie still."""
    if not len(active):
        return active
    key = (rank[active].astype(np.uint64) << np.uint64(32)) | minor.astype(np.uint64)
    order = np.argsort(key)
    key, at = key[order], active[order]
    top = key >> np.uint64(32)
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.concatenate([[True], top[1:] != top[:-1]])
    place = np.arange(len(at))
    run = np.maximum.accumulate(np.where(fresh, place, 0))
    first = np.maximum.accumulate(np.where(group, place, 0))
    rank[at] = top.astype(np.int64) + (run - first)
    still = ~fresh
    still[:-1] |= ~fresh[1:]
    return at[still]


def doubled(rank: np.ndarray, active: np.ndarray, left: np.ndarray, width: int, limit: int) -> np.ndarray:
    """Ranks of suffixes by at least limit symbols, from ranks by width symbols. left: symbols up to the end of the sequence."""
    while width < limit and len(active):
        minor = np.zeros(len(active), dtype=np.int64)
        more = left[active] > width
        minor[more] = rank[active[more] + width] + 1
        active = refine(rank, active, minor)
        width *= 2
        active = active[left[active] >= width]  # shorter ones are equal to the end, and tie for good
    return rank


def dictionary_order(phrases: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of all phrases (one after the other), equal ones alike; and where each phrase starts."""
    data = np.frombuffer(b"".join(phrases), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum([len(p) for p in phrases])]).astype(np.int64)
    left = np.repeat(start[1:], np.diff(start)) - np.arange(len(data))
    keys = tc.eights(data, ">").astype(np.uint64)
    short = np.flatnonzero(left < GRAM)
    keys[short] &= ~((np.uint64(1) << (np.uint64(8) * (GRAM - left[short]).astype(np.uint64))) - np.uint64(1))
    rank = ranks(keys)
    active = refine(rank, tied(rank), np.minimum(left, GRAM)[tied(rank)])
    active = active[left[active] >= GRAM]
    return doubled(rank, active, left, GRAM, limit), start[:-1]


def parse_order(symbols: np.ndarray, left: np.ndarray, limit: int) -> np.ndarray:
    """Ranks of the parse's suffixes. left: phrases up to the end of the string."""
    rank = ranks(symbols)
    return doubled(rank, tied(rank), left, 1, limit)


def suffix_order(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, phrase: int, limit: int) -> np.ndarray:
    """The given starts, sorted by the strings' suffixes from there on."""
    if not len(starts):
        return starts
    full = np.unique(offsets[:-1][np.diff(offsets) > 0])
    heads = np.unique(np.concatenate([full, triggers(data, offsets, phrase)]))
    string = np.searchsorted(offsets, heads, side="right") - 1
    end = offsets[string + 1]
    stop = np.minimum(np.append(heads[1:], len(data)), end)
    reach = np.minimum(stop + GRAM, end)
    reach[stop == end] = end[stop == end]
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(heads.tolist(), reach.tolist(), strict=True)], dtype=np.int64)
    suffix, first = dictionary_order(list(seen), limit)
    last = np.searchsorted(heads, end) - 1  # the last phrase of each phrase's string
    left = last - np.arange(len(heads)) + 1
    follows = parse_order(suffix[first[ids]], left, limit)
    k = np.searchsorted(heads, starts, side="right") - 1
    then = np.where(left[k] > 1, follows[np.minimum(k + 1, len(heads) - 1)] + 1, 0)
    key = (suffix[first[ids[k]] + starts - heads[k]].astype(np.uint64) << np.uint64(32)) | then.astype(np.uint64)
    return starts[np.argsort(key)]


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, compared byte for byte; most: their bounds, at most limit."""
    gram = tc.eights(data)
    out = most.astype(np.int64).copy()
    active = np.arange(len(a))
    for j in range(0, limit, GRAM):
        active = active[out[active] > j]
        if not len(active):
            break
        x = gram[a[active] + j] ^ gram[b[active] + j]
        odd = x != 0
        y = x[odd]
        lowest = y & (~y + np.uint64(1))
        at = active[odd]
        out[at] = np.minimum(out[at], j + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
        active = active[~odd]
    return out


def longest_repeats(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, phrase: int, limit: int) -> np.ndarray:
    """For each start (ascending), the longest prefix of its suffix, up to limit bytes, that another of the starts has too: the greater of the two neighbours' in suffix order."""
    order = suffix_order(data, offsets, starts, phrase, limit)
    out = np.zeros(len(starts), dtype=np.int64)
    if len(order) > 1:
        left = np.minimum(offsets[np.searchsorted(offsets, order, side="right")] - order, limit)
        shared = common_prefixes(data, order[:-1], order[1:], np.minimum(left[1:], left[:-1]), limit)
        place = np.searchsorted(starts, order)
        out[place[1:]] = shared
        out[place[:-1]] = np.maximum(out[place[:-1]], shared)
    return out
