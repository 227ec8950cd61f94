import random

import pytest

SCHEMA = "doc_id long, text string, digest string, x_digest int, block string"


@pytest.fixture(scope="session")
def made():
    """Rows with nulls, empty and long texts, ties, repeated rows, near copies and columns whose names clash with inner ones."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(k, text(rnd.randint(1, 120))) for k in range(60)]
    passage = text(150)
    rows += [(100 + k, f"{text(30)} {passage} {text(30)}") for k in range(4)]
    base = text(200).split()
    for k in range(6):
        near = list(base)
        for j in range(k):
            near[j * 31] = f"new{j}"
        rows.append((200 + k, " ".join(near)))
    rows += [(300, rows[0][1]), (301, rows[0][1].upper()), (302, rows[0][1]), (302, rows[0][1])]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "a b c d"), (406, "A B C D"), (None, text(40)), (None, None)]
    rows += [(500, "orre " * 3000), (501, text(8000)), (502, "日本語 テキスト 😀 ▁ x"), (503, "ab" * 900)]
    return [(*r, "d", 1, "b") for r in rows]


@pytest.fixture(scope="session")
def docs(spark, made):
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
