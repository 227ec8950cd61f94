import itertools
import random
import re
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlattice.llm import sentencepiece_codec as sp

with open(sp.MODEL, "rb") as _f:
    MODEL = sp.read_model(_f.read())
SEGMENTER, SPELLER = sp.Segmenter(MODEL), sp.Speller(MODEL)
SCORE = {t: (s, k) for k, (t, s, kind) in enumerate(MODEL["pieces"]) if kind in (sp.NORMAL, sp.USER)}


def brute(text):
    """Best score and its last-piece-longest segmentation, trying every piece at every position of the whole text."""
    seen = (" " + text).replace(sp.SPACE_MARK, "\x00").replace(" ", sp.SPACE_MARK)
    best, back = [0.0] + [-1e300] * len(seen), [None] * (len(seen) + 1)
    for e in range(1, len(seen) + 1):
        for a in range(max(0, e - 16), e):
            if seen[a:e] in SCORE and best[a] + SCORE[seen[a:e]][0] > best[e]:
                best[e], back[e] = best[a] + SCORE[seen[a:e]][0], (a, [SCORE[seen[a:e]][1]])
        if best[e - 1] + SEGMENTER.unknown_score > best[e]:
            best[e], back[e] = best[e - 1] + SEGMENTER.unknown_score, (e - 1, [SEGMENTER.byte_ids[b] for b in (" " + text)[e - 1].encode()])
    ids, e = [], len(seen)
    while e:
        e, own = back[e]
        ids = own + ids
    return ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdent iouérs  \n\t▁日x😀"), max_size=40))
def test_viterbi_is_the_brute_force_one(text):
    ids = np.frombuffer(SEGMENTER.encode(text), dtype=np.int32)
    assert list(ids) == (brute(text) if text else [])
    assert SPELLER.decode(ids) == text.encode()


def test_tables(spark, docs, made, empty):
    rows = sp.encode(docs).collect()
    assert len(rows) == len(made) and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in rows)
    back = sp.decode(sp.encode(docs)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((i, t or "")) for i, t, *_ in made)
    assert sp.encode(empty).count() == 0


def test_scores_are_those_of_the_library():
    library = pytest.importorskip("sentencepiece")
    p = library.SentencePieceProcessor(model_file=sp.MODEL)
    assert p.get_piece_size() == len(MODEL["pieces"])
    for k in range(0, p.get_piece_size(), 97):
        assert p.id_to_piece(k) == MODEL["pieces"][k][0] and p.get_score(k) == pytest.approx(MODEL["pieces"][k][1])


def test_distinct_units_are_walked_together_not_one_by_one():
    words = ["".join(w) for w in itertools.product("abcdefgh", repeat=4)]
    texts = [" ".join(words[k::8]) for k in range(8)] * 2
    with open(sp.MODEL, "rb") as f:
        run = sp.coder(SimpleNamespace(value=f.read()))
    one, many = (pa.RecordBatch.from_pydict({"doc_id": range(len(t)), "text": t}) for t in (["a"], texts))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call" and frame.f_code.co_filename == sp.__file__

    batches = run(iter([one, many]))
    next(batches)
    sys.setprofile(count)
    coded = next(batches)
    sys.setprofile(None)
    assert coded.column("round_trip").to_pylist() == [True] * 16
    assert calls < len(words) / 4
    assert [x.as_py() for x in coded.column("ids")] == [brute(t) for t in texts]


@pytest.mark.parametrize("bytes_left", [256, 200, 0])
def test_a_walk_is_what_each_unit_gives_alone(bytes_left):
    left = [p if p[2] != sp.BYTE or int(p[0][3:5], 16) < bytes_left else ("gone", 0.0, sp.UNUSED) for p in MODEL["pieces"]]
    segmenter, rnd = sp.Segmenter(MODEL | {"pieces": left}), random.Random(7)
    texts = ["".join(rnd.choice("abcdent iouérs  \n\t▁日x😀\0漢か") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    units = sorted({u for t in texts for u in sp.UNIT.findall((" " + t).encode())}, key=len, reverse=True)
    assert segmenter.walk(units) == [segmenter.segment(u) for u in units]
    if bytes_left == 256:
        assert [list(np.frombuffer(x, dtype=np.int32)) for x in segmenter.encode_all([t.encode() for t in texts])] == [brute(t) if t else [] for t in texts]


def test_long_texts_are_cut_where_a_unit_ends(monkeypatch):
    monkeypatch.setattr(sp.tc, "PIECE", 50)
    rnd = random.Random(9)
    for text in ("".join(rnd.choice("ab日  ") for _ in range(2000)), "x" * 500, " " * 500, "x" * 300 + " y" * 300):
        parts = list(sp.slices(text.encode()))
        assert b"".join(parts) == text.encode() and [u for p in parts for u in sp.UNIT.findall(p)] == [u.encode() for u in re.findall("[^ ]+| +[^ ]*", text)]
        assert list(np.frombuffer(SEGMENTER.encode(text), dtype=np.int32)) == brute(text)
