"""Whole objects are read as json reads them; damaged ones as far as they go."""

import json
import random

import pytest

from barlattice.operators import replies


def made(rnd, depth=0):
    kind = rnd.choice(["s", "n", "f", "b", "o", "a"] if depth < 3 else ["s", "n", "b"])
    if kind == "o":
        return {f"k{j}": made(rnd, depth + 1) for j in range(rnd.randint(0, 4))}
    if kind == "a":
        return [made(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {"s": "".join(rnd.choice('ab{}[],:"\'\\ \n中😀') for _ in range(rnd.randint(0, 8))), "n": rnd.randint(-99, 99), "f": rnd.randint(-99, 99) / 4, "b": rnd.choice([True, False, None])}[kind]


def test_whole_objects_are_those_of_json():
    rnd = random.Random(1)
    for _ in range(2000):
        x = {f"m{j}": made(rnd) for j in range(rnd.randint(1, 4))}
        text = json.dumps(x, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))
        assert replies.first_object(f"so: ```json\n{text}\n``` that's it {{}}") == x


def plain_prefix(cut, whole):
    """What a prefix of an object may say: members of the whole one, the last one cut."""
    if isinstance(whole, dict) and isinstance(cut, dict):
        names = list(whole)[: len(cut)]
        return list(cut) == names and all(cut[n] == whole[n] for n in names[:-1]) and (not names or plain_prefix(cut[names[-1]], whole[names[-1]]))
    if isinstance(whole, list) and isinstance(cut, list):
        return cut[:-1] == whole[: max(0, len(cut) - 1)] and len(cut) <= len(whole) and (not cut or plain_prefix(cut[-1], whole[len(cut) - 1]))
    return True


def test_objects_cut_anywhere_keep_what_was_whole():
    rnd = random.Random(2)
    for _ in range(300):
        x = {f"m{j}": made(rnd) for j in range(3)}
        text = json.dumps(x, ensure_ascii=False)
        for end in range(1, len(text)):
            got = replies.first_object(text[:end])
            assert plain_prefix(got or {}, x), (text[:end], got)


@pytest.mark.parametrize(("text", "want"), [
    ("{'verdict': 'watch', 'confidence': 61,}", {"verdict": "watch", "confidence": 61, "found": True}),
    ("{verdict: avoid, confidence: 40.7, nested: {a: [1, 2", {"verdict": "avoid", "confidence": 40, "found": True}),
    ("{“裁决”：“推荐”，“置信度”：“85分”，“理由”：“量价\n齐升”", {"verdict": "推荐", "confidence": 85, "reason": "量价\n齐升", "found": True}),
    ('{} then {"Risk_Level": "high", "max_position_pct": "30%", "key_concern": ["a", 1]}', {"risk_level": "high", "max_position_pct": 30, "key_concern": '["a", 1]', "found": True}),
    ('{"verdict": "wat', {"verdict": "wat", "found": True}),
    ('{"verdict":', {"verdict": "观望", "confidence": 50, "reason": '{"verdict":', "found": False}),
    ("no idea", {"verdict": "观望", "confidence": 50, "reason": "no idea", "found": False}),
    (None, {"verdict": "观望", "confidence": 50, "reason": "", "found": False}),
    ("{" * 5000, {"verdict": "观望", "confidence": 50, "reason": "{" * 100, "found": False}),
])
def test_replies(spark, text, want):
    assert replies.verdict_of(text) == want
    row = replies.verdicts(spark.createDataFrame([(1, text)], "id long, reply string"), "id", "reply").first().asDict()
    assert {k: v for k, v in row.items() if v is not None and k != "id"} == want
