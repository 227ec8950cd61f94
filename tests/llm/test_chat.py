import hashlib
import json
import random

from hypothesis import given
from hypothesis import strategies as st

from barlattice.llm import chat

TRICKY = ["<|>", "\\", "|", "<|end|>\n", "a\\|>", "<|user|>\n", "\\\\|", "\\/", "", r"\### Assistant: </turn> ok", "<|assistant|>\nx<|end|>\n"]


@given(st.lists(st.tuples(st.sampled_from([*TRICKY, "user", "assistant", "system"]), st.one_of(st.sampled_from(TRICKY), st.text(alphabet="<|>\\/end\nusrai", max_size=20))), max_size=5))
def test_any_turns_come_back(turns):
    text, mask = chat.format_turns(turns)
    assert [(r, t) for r, t, _, _ in chat.read_turns(text)] == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == chat.ASSISTANT]


def test_layouts_become_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    layouts = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"question": "q", "answer": "a"}]
    assert all(chat.Registry().turns(x)[1] == want for x in layouts)
    assert chat.Registry().turns({"system": "s", "prompt": "q", "response": "a"})[1] == [("system", "s"), *want]
    assert chat.Registry().turns({"other": 1})[1] is None and chat.Registry().turns({"messages": []})[1] == []
    rows = [(k, json.dumps(x)) for k, x in enumerate([*layouts, {"odd": {"deep": [1]}}])] + [(90, None), (91, "{broken")]
    got = {r["record_id"]: r for r in chat.format_records(spark.createDataFrame(rows, "record_id long, record string")).collect()}
    assert len(got) == len(rows) and all(got[k]["formatted"] == chat.format_turns(want)[0] for k in range(len(layouts)))
    assert got[len(layouts)]["formatted"] is None and got[90]["formatted"] is None and got[91]["fingerprint"]


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "<|end|>"), (1, 0, "user", None), (1, 1, "assistant", "<|end|>"), (2, None, None, "x"), (None, 0, "assistant", "é"), *[(3, k, "assistant", TRICKY[k % len(TRICKY)]) for k in range(500)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    for c, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["formatted_chars"] == len(chat.format_turns(turns)[0])
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_stored_conversations_read_back_in_any_order(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} |") for c in range(20) for t in range(12)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(map(tuple, chat.read_conversations(formatted, in_order=True).collect()))
    stored = spark.createDataFrame(formatted.collect()[::-1], formatted.schema).repartition(7)
    assert want == sorted(map(tuple, chat.read_conversations(stored).collect())) and len(want) == 20


def test_mixed_layouts_give_the_turns_of_plain_rows(spark):
    """Turns as records of four layouts, formatted and read back, say what the rows themselves say."""
    from barlattice.llm import queries

    rnd, rows = random.Random(8), []
    for k in range(30):
        for t in range(rnd.randint(1, 6)):
            rows.append((k if k % 7 else None, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice([None, "", "a|b\\", "<|end|>\n", "é\n{\"x\": 1}", "w " * 50])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = queries.mixed_records(df)
    turns = chat.canonical_turns(records)
    assert turns.where("piece IS NULL").count() == 0 and turns.select("fingerprint").distinct().count() == 4
    read = lambda x: sorted(map(tuple, chat.read_conversations(chat.format_conversations(x)).collect()), key=str)
    assert read(turns) == read(df)


def test_records_of_several_turns_stay_in_order(spark):
    records = [(1, 2, '{"prompt": "q2", "completion": "a2"}'), (1, 1, '{"messages": [{"role": "user", "content": "z"}, {"role": "assistant", "content": "y"}, {"role": "user", "content": "x"}]}'), (2, 1, '{"odd": 1}'), (2, 2, None), (3, 1, "[" * 100_000)]
    turns = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, turn long, record string"))
    formatted = "".join(r["formatted"] for r in chat.format_conversations(turns).orderBy("conv_id", "turn_no").collect())
    assert [t[:2] for t in chat.read_turns(formatted)] == [("user", "z"), ("assistant", "y"), ("user", "x"), ("user", "q2"), ("assistant", "a2")]
    assert sorted((r["conv_id"], r["turn"]) for r in turns.where("piece IS NULL").collect()) == [(2, 1), (2, 2), (3, 1)]
    assert chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, record string")).count() == 0
