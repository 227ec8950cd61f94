"""Token counts are those of the tokenizer's own library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from barlattice.llm import token_counts as tk

MIXED = ["a", "B", "é", "1", "²", "٣", "ⅷ", " ", " ", "  ", "\n", "\t", "　", "\xa0", "'", "'s", "'re", "'ll", "'d", "'ve", "'S", ".", "!?", "日", "😀", "́", "<|endoftext|>", "<|endof", "|>", "​", "\x85", "\x1c", "ß", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tk.MODEL)


def mixed(n, size=14):
    rnd = random.Random(n)
    return ["".join(rnd.choice(MIXED) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_cuts_are_the_pre_tokens_of_the_library(library):
    texts = mixed(3000)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    whole = b"".join(raw)
    start = tk.cuts(np.frombuffer(whole, dtype=np.uint8), offsets, tk.Model(tk.MODEL))
    got = [[] for _ in texts]
    for a, b, of in zip(start, [*start[1:], len(whole)], np.searchsorted(offsets, start, side="right") - 1, strict=True):
        got[of].append(whole[a:b].decode())
    for text, mine in zip(texts, got, strict=True):
        want = []
        for k, part in enumerate(text.split("<|endoftext|>")):
            want += ["<|endoftext|>"] * (k > 0) + [part[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(part)]
        assert mine == want


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_counts_equal_the_library(spark, made, library, block_bytes):
    rows = [r[:2] for r in made] + [(1000 + k, t) for k, t in enumerate(mixed(200, 60))] + [(2000, "x" * 200_000), (2001, "<|endoftext|>" * 3 + " a")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, block int, token string").repartition(3)
    got = sorted((tuple(r) for r in tk.count_tokens(docs, block_bytes=block_bytes).collect()), key=str)
    count = [len(library.encode(t or "", add_special_tokens=False)) for _, t in rows]
    assert got == sorted(((k, len((t or "").encode()), n, n > 1024) for (k, t), n in zip(rows, count, strict=True)), key=str)


def test_distinct_pre_tokens_are_counted_once(spark, docs, monkeypatch):
    plan = tk.count_tokens(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


def test_empty_table_and_other_tokenizers(empty):
    assert tk.count_tokens(empty).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        tk.Model(tk.MODEL.replace("byte_bpe_50k", "word_bpe_49k"))
