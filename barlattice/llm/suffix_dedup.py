"""Suffix dedup over prefix-free parsing: removes every byte that a string of `length` bytes covers which also starts elsewhere.

1. Parse. A trigger is a place whose next eight bytes hash below a bound; phrases run from trigger to trigger (about
   `phrase` bytes each), so equal strings are cut alike wherever they stand. One exchange of phrase hashes tells each
   block how often its phrases occur in the corpus. A string that occurs twice has the same phrases inside both times,
   so starts whose next `short` bytes hold a phrase that occurs once are settled. (A hash that two phrases share only
   leaves more starts open: no result depends on hashes here.) Where these bytes hold no whole phrase, the phrases of a
   denser parse take their place.
2. Shares. An open start belongs to its anchor: the rarest of the whole phrases in its next `short` bytes. The anchor
   depends on these bytes alone, so equal strings share it. Runs of starts with one anchor are sent, as one string of
   the text that reaches `length` bytes beyond the last of them, to the task of their anchor; equal ones once a block.
3. Corpus order. A task parses the strings of its anchors again and combines the suffix arrays of their dictionary
   and their parse into the order of their suffixes (`corpus_order`); neighbours, compared byte by byte, give the
   longest prefix that each start has in common with another one. Strings that come twice have all of theirs.
   Blocks get these lengths back, and mark what the repeated strings cover.
4. Anchors in more than `hot` places (and starts whose next bytes hold no whole phrase) would gather in one task:
   their starts are compared by 128-bit BLAKE2 digests of the strings themselves, each once a block, dealt by their bits.

All steps cover all bytes; nothing is sampled. Matches never cross texts. Besides the removed bytes, `n_repeated` counts
those under shorter passages that stay: any string of `words` words and the space after them (clipped to `short` to
`length` bytes; the first word may be cut) that also starts elsewhere. Defined results: null text is the empty text; texts shorter than `length` keep all bytes; repeated
rows are texts like any others, so equal texts of at least `length` bytes lose everything. Removed bytes may cut a
character; the digest is of the bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlattice.llm import blocks as bl
from barlattice.llm import corpus_order as co
from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, materialise
from barlattice.llm.grouped import by_runs

by_value(__name__)

LENGTH = 400
SHORT = 200
WORDS = 50
PHRASE = 24
#: How much denser the triggers of the second parse are, and what sets its phrases apart.
DENSER, FINE = 4, np.uint64(0xA24BAED4963EE407)
GRAM = co.GRAM
#: An anchor phrase in more places than this is hot.
HOT = 1 << 13
#: Parts of a block that are worked on at once, bytes.
PART = 1 << 20
#: Bytes of strings that one task puts in order, about.
SHARE_BYTES = 8 << 20


class Texts:
    """Some texts, one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def spans(self, starts: np.ndarray, short: int, length: int, words: int) -> np.ndarray:
        """Bytes of the string of so many words (the first may be cut) and the space after them, from each start on, clipped; length where the text has none."""
        _, end, of = tc.words(self.data, self.offsets)
        k = np.searchsorted(end, starts, side="right") + words - 1
        text = np.searchsorted(self.offsets, starts, side="right") - 1
        there = k < len(end)
        there[there] = (of[k[there]] == text[there]) & (end[k[there]] < self.offsets[text[there] + 1])
        out = np.full(len(starts), length, dtype=np.int64)
        out[there] = np.clip(end[k[there]] + 1 - starts[there], short, length)
        return out


class Level:
    """The phrases of one density of triggers, and the runs of starts in some ranges whose next `short` bytes hold the same ones."""

    def __init__(self, at: np.ndarray, first: np.ndarray, past: np.ndarray, short: int) -> None:
        """at: triggers; first, past: the ranges of starts, ascending; windows of starts in a range stay in one text.

        A start's triggers change where its first is passed and where a further one comes in."""
        self.at = at
        cuts = np.concatenate([first, at + 1, at + GRAM - short])
        of = np.searchsorted(first, cuts, side="right") - 1
        inside = of >= 0
        inside[inside] = cuts[inside] < past[of[inside]]
        self.start = distinct_sorted(cuts[inside])
        self.stop = np.minimum(np.append(self.start[1:], np.iinfo(np.int64).max), past[np.searchsorted(first, self.start, side="right") - 1]) if len(self.start) else self.start
        # phrase k runs from trigger k to trigger k + 1; a to z - 1 are whole in the windows of a run
        self.a = np.searchsorted(at, self.start)
        self.z = np.searchsorted(at, self.start + short - GRAM, side="right") - 1
        self.none = self.z <= self.a
        some = ~self.none
        mark = np.bincount(self.a[some], minlength=len(at) + 1) - np.bincount(self.z[some], minlength=len(at) + 1)
        #: The phrases that any of the windows holds whole.
        self.held = np.flatnonzero(np.cumsum(mark)[: len(at)] > 0)

    def ranges_of_none(self) -> tuple[np.ndarray, np.ndarray]:
        start, stop = self.start[self.none], self.stop[self.none]
        head = np.concatenate([[True], start[1:] != stop[:-1]]) if len(start) else np.zeros(0, dtype=bool)
        return start[head], stop[np.append(np.flatnonzero(head)[1:], len(start)) - 1] if len(start) else stop

    def anchors(self, value: np.ndarray) -> np.ndarray:
        """The least value of the phrases of each run that has any. value: by held phrase."""
        full = np.full(len(self.at) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        full[self.held] = value
        return range_min(full, self.a[~self.none], self.z[~self.none])


class Parsed(Texts):
    """Phrases of some texts, and the starts that may repeat. Where the next bytes hold no whole phrase, phrases of a denser parse serve."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, short: int, phrase: int, powers: tc.Powers) -> None:
        super().__init__(data, offsets)
        roll = tc.Rolling(data, powers)
        first, past = offsets[:-1], offsets[1:] - short + 1
        long = past > first
        coarse = Level(co.triggers(data, offsets, phrase), first[long], past[long], short)
        fine = Level(co.triggers(data, offsets, max(2, phrase // DENSER)), *coarse.ranges_of_none(), short)
        self.levels = (coarse, fine)
        self.keys = np.concatenate([roll(x.at[x.held], x.at[x.held + 1]) ^ salt for x, salt in zip(self.levels, (np.uint64(0), FINE), strict=True)])

    def runs(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First start, end of starts, anchor and its level of the open runs. level: by key, the logarithm of its count, 0 for one that occurs once."""
        value = (level.astype(np.uint64) << np.uint64(56)) | (tc.mix(self.keys) >> np.uint64(8))
        coarse, fine = self.levels
        n = len(coarse.held)
        bare = np.full(int(fine.none.sum()), np.uint64(0xFF) << np.uint64(56))
        start = np.concatenate([coarse.start[~coarse.none], fine.start[~fine.none], fine.start[fine.none]])
        stop = np.concatenate([coarse.stop[~coarse.none], fine.stop[~fine.none], fine.stop[fine.none]])
        anchor = np.concatenate([coarse.anchors(value[:n]), fine.anchors(value[n:]), bare])
        order = np.argsort(start, kind="stable")
        order = order[anchor[order] >> np.uint64(56) > 0]
        start, stop, anchor = start[order], stop[order], anchor[order]
        if not len(start):
            return start, stop, anchor, start
        text = np.searchsorted(self.offsets, start, side="right")
        head = np.flatnonzero(np.concatenate([[True], (start[1:] != stop[:-1]) | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        return start[head], stop[np.append(head[1:], len(start)) - 1], anchor[head], (anchor[head] >> np.uint64(56)).astype(np.int64)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def range_min(value: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of value[a:z], for each pair; a < z."""
    out = np.empty(len(a), dtype=value.dtype)
    if not len(a):
        return out
    width = np.floor(np.log2(z - a)).astype(np.int64)
    table, w = value, 0
    for level in range(int(width.max()) + 1):
        pick = width == level
        out[pick] = np.minimum(table[a[pick]], table[z[pick] - w if w else z[pick] - 1]) if level else table[a[pick]]
        w = 1 << level
        table = np.minimum(table[:-w], table[w:]) if len(table) > w else table
        w *= 2
    return out


def expanded(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of all ranges."""
    size = stop - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def count_levels(first: np.ndarray, second: np.ndarray, lead: np.ndarray) -> bytes:
    """The logarithm of each count, cut to a whole number: 0 for what occurs once."""
    return bl.pack_counts(np.log2(np.maximum(first, 1)).astype(np.uint32))


class Strings:
    """A block's distinct strings of open starts: bytes, number of starts, anchor, whether they come twice, whether they are hot; and where they stand."""

    def __init__(self, rounds: Rounds, row: dict) -> None:
        parts = list(rounds.parts(row))
        told = distinct_sorted(np.concatenate([p.keys for p in parts])) if parts else np.zeros(0, dtype=np.uint64)
        level = np.concatenate([bl.unpack_counts(c)[0] for c in row["replies"][0]] or [np.zeros(0, dtype=np.uint32)])
        self.parts = parts
        #: By part: first start, end of starts, number of the string.
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: dict[tuple[int, bytes], int] = {}
        anchors: list[int] = []
        twice: list[bool] = []
        hot: list[bool] = []
        for p in parts:
            start, stop, anchor, rare = p.runs(level[np.searchsorted(told, p.keys)])
            end = np.minimum(stop - 1 + rounds.length, p.offsets[np.searchsorted(p.offsets, start, side="right")])
            raw = p.data.tobytes()
            number = np.empty(len(start), dtype=np.int64)
            for k, (a, n, z, key, hub) in enumerate(zip(start.tolist(), (stop - start).tolist(), end.tolist(), anchor.tolist(), (rare >= rounds.hot_level).tolist(), strict=True)):
                known = len(seen)
                j = number[k] = seen.setdefault((n, raw[a:z]), known)
                if j == known:
                    anchors.append(key)
                    twice.append(False)
                    hot.append(hub)
                else:
                    twice[j] = True
            self.runs.append((start, stop, number))
        self.strings = list(seen)
        self.anchors = tc.mix(np.array(anchors, dtype=np.uint64))
        self.twice, self.hot = np.array(twice, dtype=bool), np.array(hot, dtype=bool)
        #: Cold strings by share; hot ones.
        self.hot_ones = np.flatnonzero(self.hot)
        cold = np.flatnonzero(~self.hot)
        self.cold = cold[np.argsort(self.anchors[cold], kind="stable")]


class Rounds:
    """What a block says in each round, given the answers so far."""

    def __init__(self, length: int, short: int, words: int, phrase: int, hot: int) -> None:
        self.length, self.short, self.words, self.phrase = length, short, words, phrase
        self.hot_level = max(1, math.ceil(math.log2(hot)))
        self.powers = tc.Powers()

    def parts(self, row: dict) -> Iterator[Parsed]:
        _, data, offsets = bl.docs_of(row)
        for _, _, part, off in bl.pieces_of(data, offsets, PART):
            yield Parsed(part, off, self.short, self.phrase, self.powers)

    def phrases(self, row: dict) -> tuple:
        keys = np.sort(np.concatenate([p.keys for p in self.parts(row)]))
        at, n = tc.sorted_runs(keys)
        return keys[at], n.astype(np.uint32), np.zeros(len(n), dtype=np.uint32)

    def sender(self, bits: int):
        """Cold strings go to the share of their anchor, the digests of hot ones' starts to that of their first bits."""

        def dealt(keys: np.ndarray) -> list[np.ndarray]:
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
            return np.split(np.arange(len(keys)), np.searchsorted(bucket, np.arange(1, 1 << bits)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in bl.rows_of(batch, 1):
                    s = Strings(self, row)
                    digest, times, _ = self.digests(s)
                    for bucket, (mine, marks) in enumerate(zip(dealt(s.anchors[s.cold]), dealt(digest[:, 0]), strict=True)):
                        if not len(mine) and not len(marks):
                            continue
                        own = s.cold[mine]
                        size = np.array([len(s.strings[j][1]) for j in own], dtype=np.int64)
                        starts = np.array([s.strings[j][0] for j in own], dtype=np.int64)
                        cells = (pa.compress(b"".join(s.strings[j][1] for j in own), codec="zstd", asbytes=True), size.tobytes(), starts.tobytes(), s.anchors[own].tobytes(), s.twice[own].tobytes(), digest[marks].tobytes(), times[marks].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], type=pa.int32()), pa.array([row["block"]], type=pa.int64()), *(pa.array([c], type=pa.binary()) for c in cells)], schema=SENT)

        return run

    def digests(self, s: Strings) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sorted distinct digests of the strings at the starts of hot strings, as two numbers each; how often each comes here (2: twice or more); and each one's place: of the long string at each start, then of the passage, -1 for none."""
        seen: dict[bytes, int] = {}
        times: list[int] = []
        place: tuple[list[int], list[int]] = ([], [])
        for j in s.hot_ones:
            n, raw = s.strings[j]
            more = 1 + int(s.twice[j])
            for i, w in enumerate(self.spans_of(raw, n).tolist()):
                for kind, size in enumerate((self.length, w)):
                    k = -1
                    if i + size <= len(raw) and not (kind and w == self.length):
                        known = len(times)
                        k = seen.setdefault(hashlib.blake2b(raw[i : i + size], digest_size=16).digest(), known)
                        if k == known:
                            times.append(0)
                        times[k] = min(2, times[k] + more)
                    place[kind].append(k)
        flat = np.frombuffer(b"".join(seen), dtype=np.uint64).reshape(-1, 2)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        new = np.empty(len(order) + 1, dtype=np.int64)
        new[order], new[-1] = np.arange(len(order)), -1
        return flat[order], np.array(times, dtype=np.uint8)[order], [new[np.array(x, dtype=np.int64)] for x in place]

    def spans_of(self, raw: bytes, n: int) -> np.ndarray:
        text = Texts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        return text.spans(np.arange(n), self.short, self.length, self.words)

    def orderer(self):
        def each(t: pa.Table, a: int, b: int) -> Iterator[dict]:
            cell = lambda name, k, kind: np.frombuffer(t.column(name)[k].as_buffer(), dtype=kind)
            seen: dict[tuple[int, bytes], int] = {}
            times: list[int] = []
            anchors: list[int] = []
            number: list[np.ndarray] = []
            for k in range(a, b):
                size = cell("sizes", k, np.int64)
                raw = pa.decompress(t.column("data")[k].as_buffer(), int(size.sum()), codec="zstd", asbytes=True)
                end = np.cumsum(size).tolist()
                mine, at = [], 0
                for z, n, anchor, more in zip(end, cell("starts", k, np.int64).tolist(), cell("anchors", k, np.uint64).tolist(), cell("twice", k, bool).tolist(), strict=True):
                    known = len(seen)
                    j = seen.setdefault((n, raw[at:z]), known)
                    if j == known:
                        times.append(0)
                        anchors.append(anchor)
                    times[j] += 1 + more
                    mine.append(j)
                    at = z
                number.append(np.array(mine, dtype=np.int64))
            code = self.repeats(list(seen), np.array(times), np.array(anchors, dtype=np.uint64))
            again = repeated_digests([cell("digests", k, np.uint64).reshape(-1, 2) for k in range(a, b)], [cell("times", k, np.uint8) for k in range(a, b)])
            for k, mine, marks in zip(range(a, b), number, again, strict=True):
                yield {"block": [t.column("block")[k].as_py()], "bucket": [t.column("bucket")[k].as_py()], "reply": [b"".join([np.int64(len(marks)).tobytes(), marks.tobytes(), *(code[j].tobytes() for j in mine)])]}

        return by_runs(["bucket"], each, REPLY, rows=64)

    def repeats(self, strings: list[tuple[int, bytes]], times: np.ndarray, anchors: np.ndarray) -> list[np.ndarray]:
        """By string, for each of its starts: the bytes that it has in common with another start of the corpus."""
        size = np.array([len(s) for _, s in strings], dtype=np.int64)
        n = np.array([k for k, _ in strings], dtype=np.int64)
        out = [np.minimum(s - np.arange(k), self.length).astype(np.uint16) if m > 1 else np.zeros(k, dtype=np.uint16) for s, k, m in zip(size, n, times, strict=True)]
        # a string that is alone with its anchor can only repeat inside itself
        order = np.argsort(anchors, kind="stable")
        at, run = tc.sorted_runs(anchors[order])
        alone = np.zeros(len(strings), dtype=bool)
        alone[order[at[run == 1]]] = True
        if len(at):  # nor does an anchor matter whose strings all come twice
            alone[order] |= np.repeat(np.minimum.reduceat(times[order], at) > 1, run)
        single = np.flatnonzero(alone & (times < 2))
        alone[single[self.repeat_inside([strings[j][1] for j in single])]] = False
        pick = np.flatnonzero(~alone)
        if len(pick):
            data = np.frombuffer(b"".join(strings[j][1] for j in pick), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size[pick])])
            starts = expanded(offsets[:-1], offsets[:-1] + n[pick])
            got = co.longest_repeats(data, offsets, starts, self.phrase, self.length).astype(np.uint16)
            for j, part in zip(pick, np.split(got, np.cumsum(n[pick])[:-1]), strict=True):
                if times[j] < 2:
                    out[j] = part
        return out

    def repeat_inside(self, strings: list[bytes]) -> np.ndarray:
        """Whether the eight bytes at any trigger of a string come twice in it; equal strings in one have all triggers in common."""
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
        at = co.triggers(data, offsets, max(2, self.phrase // DENSER))
        gram, of = tc.eights(data)[at], np.searchsorted(offsets, at, side="right") - 1
        order = np.lexsort((gram, of))
        same = (gram[order][1:] == gram[order][:-1]) & (of[order][1:] == of[order][:-1])
        return np.bincount(of[order][1:][same], minlength=len(strings)) > 0

    def cover(self, row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, offsets, which bytes go, and which are under repeated passages, of each part."""
        s = Strings(self, row)
        first = np.zeros(len(s.strings) + 1, dtype=np.int64)
        order = np.concatenate([s.cold, s.hot_ones])
        count = np.array([s.strings[j][0] for j in order], dtype=np.int64)
        cold_starts = int(count[: len(s.cold)].sum())
        first[order] = np.cumsum(count) - count
        _, _, place = self.digests(s)
        told, again = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=bool)]
        for c in row["replies"][1]:
            marks = int(np.frombuffer(c, dtype=np.int64, count=1)[0])
            again.append(np.frombuffer(c, dtype=bool, count=marks, offset=8))
            told.append(np.frombuffer(c, dtype=np.uint16, offset=8 + marks))
        again = np.concatenate([*again, [False]])
        told = np.concatenate([*told, np.zeros(int(count.sum()) - cold_starts, dtype=np.uint16)]).astype(np.int64)
        full, part = told >= self.length, np.zeros(len(told), dtype=bool)
        full[cold_starts:], part[cold_starts:] = (again[x] for x in place)
        for p, (start, stop, number) in zip(s.parts, s.runs, strict=True):
            at = expanded(start, stop)
            j = expanded(first[number], first[number] + stop - start)
            span = p.spans(at, self.short, self.length, self.words)
            less = part[j] | (told[j] >= span)
            gone = covered(len(p.data), at[full[j]], at[full[j]] + self.length)
            yield p.data, p.offsets, gone, gone | covered(len(p.data), at[less], at[less] + span[less])


def repeated_digests(cells: list[np.ndarray], times: list[np.ndarray]) -> list[np.ndarray]:
    """Which of the digests come twice or more, by block."""
    flat, n = np.concatenate(cells), np.concatenate(times).astype(np.int64)
    if not len(flat):
        return [np.zeros(0, dtype=bool) for _ in cells]
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    fresh = np.concatenate([[True], (flat[order][1:] != flat[order][:-1]).any(axis=1)])
    run = np.cumsum(fresh) - 1
    out = np.empty(len(flat), dtype=bool)
    out[order] = (np.bincount(run, weights=n[order]) > 1)[run]
    return np.split(out, np.cumsum([len(c) for c in cells])[:-1])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    mark = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("sizes", pa.binary()), ("starts", pa.binary()), ("anchors", pa.binary()), ("twice", pa.binary()), ("digests", pa.binary()), ("times", pa.binary())])
REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64()), ("kept", pa.binary())])


def per_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def remover(rounds: Rounds, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in bl.rows_of(batch, 2):
                done = 0
                for data, offsets, gone, repeated in rounds.cover(row):
                    texts = len(offsets) - 1
                    removed = per_text(gone, offsets)
                    begins = gone.copy()
                    begins[1:] &= ~gone[:-1]
                    head = offsets[:-1][offsets[:-1] < len(data)]
                    begins[head] = gone[head]
                    kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(offsets[:-1], offsets[1:], removed, strict=True)]
                    yield pa.RecordBatch.from_arrays([row["ids"].slice(done, texts), pa.array(np.diff(offsets)), pa.array(removed), pa.array(per_text(begins, offsets)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(per_text(repeated, offsets)), pa.array(kept if with_kept else [None] * texts, type=pa.binary())], schema=OUT)
                    done += texts

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = SHORT, words: int = WORDS, phrase: int = PHRASE, hot: int = HOT, block_bytes: int = bl.BLOCK_BYTES, with_kept: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes removed or under a repeated passage of so many words), kept (the remaining bytes, if asked for)."""
    table, size = bl.make_blocks(docs, id_col, text_col, block_bytes)
    rounds = Rounds(length, min(short, length), words, phrase, hot)
    phrases = bl.exchange(table, rounds.phrases, count_levels, size / phrase)
    told = bl.attach(table, phrases)
    bits = bl.bits_for(size / SHARE_BYTES * bl.KEYS_PER_BUCKET)
    sent = told.mapInArrow(rounds.sender(bits), "bucket int, block long, data binary, sizes binary, starts binary, anchors binary, twice binary, digests binary, times binary")
    shares = sent.repartition("bucket").sortWithinPartitions("bucket", "block")
    lengths = materialise(shares.mapInArrow(rounds.orderer(), "block long, bucket int, reply binary"), "lengths")
    told = bl.attach(table, phrases, lengths)
    return told.mapInArrow(remover(rounds, with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary")
