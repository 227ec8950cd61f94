"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The model file is read as it is, never trained. The automaton (`Automaton`) runs once over a text's UTF-8 bytes; at each
position its output links give every piece that ends there, and each relaxes the best score of that position
(`Segmenter`). A character without a piece costs the lowest score less 10 and is spelled as its UTF-8 bytes, by byte
pieces. Where two ways score the same, the longer last piece wins.

No piece of such a model continues over the start of a run of spaces (checked when a model is loaded), so a text
falls apart there into units whose best segmentations are independent. The distinct units of about 1 MB of texts are
walked together, byte by byte (`Segmenter.walk`); units that are much longer than the others go one by one
(`Segmenter.segment`). Nothing is remembered beyond that 1 MB, so the work for a text does not depend on what came
before it. The literal character U+2581 is spelled as bytes, not taken for a space, so decoding gives back every text
exactly.

The pieces' own scores decide. For a model trained by byte-pair merging, whose scores are merge ranks, that is the
best sum of scores, not the sequence of merges.

Defined results: null and empty texts have no pieces and decode to the empty text. Repeated rows and ids are fine;
an empty table gives an empty result; very long texts are encoded whole, in slices that end where a unit does.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, small_batches

by_value(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE_MARK = "▁"
#: Bytes of units that are walked together.
WALKED = 1 << 17
#: A step of a walk takes about as long as so many bytes of a unit that goes alone.
STEP_COST = 75
UNIT = re.compile(b"[^ ]+| +[^ ]*")
RUN = re.compile(b"(?<! ) ")


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protobuf message's fields."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"field of kind {kind} in a model file")


def read_model(raw: bytes) -> dict:
    """pieces: (text, score, type) by id; dummy_prefix."""
    pieces, normalizer = [], {}
    for number, value in fields(raw):
        if number == 1:
            p = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
        elif number == 3:
            normalizer = dict(fields(value))
    if normalizer.get(2):
        raise ValueError("only models with the identity normalisation decode exactly")
    if normalizer.get(4, 1):
        raise ValueError("the model removes extra white space, so it can't decode exactly")
    return {"pieces": pieces, "dummy_prefix": bool(normalizer.get(3, 1))}


class Automaton:
    """Aho-Corasick automaton over words of bytes, as arrays by state: a table of all moves, and output links to the next shorter word."""

    def __init__(self, words: dict[bytes, tuple[float, int]]) -> None:
        alphabet = sorted(set(b"".join(words)))
        codes = np.zeros(256, dtype=np.uint8)
        codes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.codes, width = codes.tobytes(), len(alphabet) + 1
        levels, number, left = [], {b"": 0}, list(words)
        for depth in range(1, max(map(len, words), default=0) + 1):
            left = [w for w in left if len(w) >= depth]
            new = sorted({w[:depth] for w in left})
            levels.append((np.array([number[x[:-1]] for x in new]), codes[[x[-1] for x in new]], np.arange(len(number), len(number) + len(new))))
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        n = len(number)
        kind = np.uint16 if n <= 1 << 16 else np.int32
        # A state that no word goes on from moves as the one it falls back to, whose row it shares.
        inner = np.zeros(n, dtype=bool)
        inner[0] = True
        for parent, _, _ in levels:
            inner[parent] = True
        moves = np.zeros((int(inner.sum()), width), dtype=kind)
        row = np.cumsum(inner) - 1
        fail, self.first, self.after = (np.zeros(n, dtype=kind) for _ in range(3))
        #: Of the word that a state ends: bytes, score, id. State 0 ends none.
        self.size, self.score, self.word = np.zeros(n, dtype=np.int32), np.zeros(n), np.full(n, -1, dtype=np.int32)
        for w, (score, k) in words.items():
            self.size[number[w]], self.score[number[w]], self.word[number[w]] = len(w), score, k
        for parent, code, state in levels:
            fail[state] = moves[row[fail[parent]], code]
            moves[row[parent], code] = state
            row[state] = np.where(inner[state], row[state], row[fail[state]])
            own = state[inner[state]]
            moves[row[own]] = moves[row[fail[own]]]
            self.after[state] = self.first[fail[state]]
            self.first[state] = np.where(self.word[state] >= 0, state, self.after[state])
        self.moves, self.row = moves.ravel(), row * width

    @cached_property
    def lists(self) -> list[list]:
        """What is known by state, to be read one by one."""
        return [x.tolist() for x in (self.row, self.first, self.after, self.size, self.score, self.word)]


def slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of about 1 MB that end where a unit does."""
    at = 0
    while len(text) - at > 2 * tc.PIECE and (cut := RUN.search(text, at + tc.PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Segmenter:
    """Piece ids of texts, as int32 bytes."""

    def __init__(self, model: dict) -> None:
        self.prefix = b" " if model["dummy_prefix"] else b""
        words: dict[bytes, tuple[float, int]] = {}
        lowest = 0.0
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.unknown = 0
        for k, (text, score, kind) in enumerate(model["pieces"]):
            if kind in (NORMAL, USER):
                if text and " " not in text:
                    words[text.replace(SPACE_MARK, " ").encode()] = (score, k)
                lowest = min(lowest, score) if score > -1e8 else lowest
                if re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", text):
                    raise ValueError("a piece goes on over the start of a run of spaces")
            elif kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = k
            elif kind == UNKNOWN:
                self.unknown = k
        self.automaton = Automaton(words)
        self.unknown_score = lowest - 10.0

    def segment(self, unit: bytes) -> bytes:
        """Ids of the best segmentation of one unit."""
        a, n, unknown = self.automaton, len(unit), self.unknown_score
        moves, (row, first, after, size, score, piece) = a.moves.data, a.lists
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        last = [0] * (n + 1)
        state = begin = 0
        for end, code in enumerate(unit.translate(a.codes), 1):
            state = moves[row[state] + code]
            word = first[state]
            while word:
                s = best[end - size[word]] + score[word]
                if s > best[end]:
                    best[end], last[end] = s, word
                word = after[word]
            if end == n or unit[end] & 0xC0 != 0x80:
                if best[begin] + unknown > best[end]:
                    best[end], last[end] = best[begin] + unknown, begin - end
                begin = end
        ids: list[int] = []
        while n:
            if last[n] > 0:
                ids.append(piece[last[n]])
                n -= size[last[n]]
            else:
                spelled = self.byte_ids[list(unit[n + last[n] : n])]
                ids += [self.unknown] if -1 in spelled else spelled[::-1].tolist()
                n += last[n]
        return np.array(ids[::-1], dtype=np.int32).tobytes()

    def walk(self, units: list[bytes]) -> list[bytes]:
        """Ids of the best segmentation of each of some units, longest first: all take their next byte together."""
        a = self.automaton
        size = np.array([len(u) for u in units])
        raw = b"\0" + b"\0".join(units)
        data, code = np.frombuffer(raw, dtype=np.uint8), np.frombuffer(raw.translate(a.codes), dtype=np.uint8)
        # The byte before a unit stands for the place where it starts, any other byte for the place behind it.
        end = np.cumsum(size + 1) - 1
        start = end - size
        best = np.full(len(data), -1e300)
        best[start] = 0.0
        last = np.zeros(len(data), dtype=np.int32)
        lead, at = (data & 0xC0) != 0x80, np.arange(len(data), dtype=np.int32)
        # Bytes of the character that ends at a place, 0 inside one.
        char = np.where(np.append(lead[1:], True), at - np.maximum.accumulate(np.where(lead, at, 0)) + 1, 0)
        state = np.zeros(len(units), dtype=a.moves.dtype)
        longer = len(units) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
        for step, n in enumerate(longer, 1):
            here = start[:n] + step
            state = a.moves[a.row[state[:n]] + code[here]]
            word = a.first[state]
            found = word > 0
            word, place = word[found], here[found]
            while len(word):
                s = best[place - a.size[word]] + a.score[word]
                better = s > best[place]
                best[place[better]], last[place[better]] = s[better], word[better]
                word = a.after[word]
                found = word > 0
                word, place = word[found], place[found]
            place = here[char[here] > 0]
            s = best[place - char[place]] + self.unknown_score
            better = s > best[place]
            best[place[better]], last[place[better]] = s[better], 0
        ends, starts = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        starts[start] = True
        place = end
        while len(place):
            ends[place] = True
            place = place - np.where(last[place] > 0, a.size[last[place]], char[place])
            place = place[~starts[place]]
        place = np.flatnonzero(ends)
        ids = a.word[last[place]]
        many = np.ones(len(place), dtype=np.int64)
        odd = np.flatnonzero(last[place] == 0)
        many[odd] = char[place[odd]]
        spelled = []
        for k in range(4):
            which = odd[char[place[odd]] > k]
            byte = self.byte_ids[data[place[which] - char[place[which]] + 1 + k]]
            lost = which[byte < 0]
            many[lost], ids[lost] = 1, self.unknown
            spelled.append((which, byte))
        to = np.cumsum(many)
        out = np.repeat(ids, many)
        for k, (which, byte) in enumerate(spelled):
            known = ids[which] < 0
            out[(to - many)[which[known]] + k] = byte[known]
        joined = out.tobytes()
        bounds = 4 * np.append(0, to[np.searchsorted(place, end)])
        return [joined[x:y] for x, y in pairwise(bounds.tolist())]

    def together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; the units are sought once for all of them."""
        units = [UNIT.findall(t) for t in texts]
        distinct = sorted(set(chain.from_iterable(units)), key=len, reverse=True)
        size = np.array([len(u) for u in distinct], dtype=np.int64)
        known: dict[bytes, bytes] = {}
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // WALKED)) + 1
        for x, y in pairwise([0, *cuts.tolist(), len(distinct)]):
            alone = x + int(np.argmin(np.append(0, np.cumsum(size[x:y])) + STEP_COST * np.append(size[x:y], 0)))
            known.update((u, self.segment(u)) for u in distinct[x:alone])
            if alone < y:
                known.update(zip(distinct[alone:y], self.walk(distinct[alone:y]), strict=True))
        return [b"".join(map(known.__getitem__, u)) for u in units]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        marked = [self.prefix + t if t else b"" for t in texts]
        if len(marked) > 1:
            return self.together(marked)
        return [b"".join(chain.from_iterable(self.together([x]) for x in slices(t))) for t in marked]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([(text or "").encode()])[0]


class Speller:
    """The bytes of every piece, to decode many ids at once."""

    def __init__(self, model: dict) -> None:
        spelled = []
        for text, _, kind in model["pieces"]:
            spelled.append(bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE_MARK, " ").encode())
        self.size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.prefix = model["dummy_prefix"]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = int(size.sum())
        shift = self.start[ids] - (np.cumsum(size) - size)
        out = self.data[np.repeat(shift, size) + np.arange(total)].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])


def coder(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = read_model(raw.value)
        segmenter, speller = Segmenter(model), Speller(model)
        del model
        for batch in batches:
            for part in tc.pieces(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                coded = segmenter.encode_all(texts)
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                same = [speller.decode(flat[a:b]) == (t or b"") for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(np.diff(at).astype(np.int64)), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array(same)], schema=CODED)

    return run


def decoder(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(read_model(raw.value))
        for batch in batches:
            texts = [speller.decode(np.array(x or [], dtype=np.int32)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return run


def shared_model(df: DataFrame, model_path: str):
    """The model file's bytes, read once by the driver and sent to all executors; such files have a few MB at most."""
    small_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_pieces, ids_sha256 (of the ids as little-endian int32), round_trip (decoding them gives the text)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(coder(shared_model(docs, model_path)), "doc_id long, ids array<int>, n_pieces long, ids_sha256 string, round_trip boolean")


def decode(coded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id, ids."""
    return coded.select("doc_id", "ids").mapInArrow(decoder(shared_model(coded, model_path)), "doc_id long, text string")
