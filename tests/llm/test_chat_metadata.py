import json

from barlattice.llm import chat

WANT = [("user", "q"), ("assistant", "a")]
MESSAGES = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]


def test_metadata_does_not_hide_a_layout(spark):
    records = [
        {"id": 7, "messages": MESSAGES}, {"messages": [{**m, "name": "n"} for m in MESSAGES]}, {"source": {"url": "u"}, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"id": 1, "prompt": "q", "response": "a"}, {"id": 1, "instruction": "q", "input": "", "output": "a", "tags": ["x"]},
    ]
    assert all(chat.Registry().turns(x)[1] == WANT for x in records)
    assert chat.Registry().turns({"id": 1, "system": "s", "prompt": "q", "response": "a"})[1] == [("system", "s"), *WANT]
    assert chat.Registry().turns({"id": 1, "messages": []})[1] == [] and chat.Registry().turns({"id": 1, "role": "user"})[1] is None
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(records)], "record_id long, record string")
    assert {r["formatted"] for r in chat.format_records(df).collect()} == {chat.format_turns(WANT)[0]}


def test_fields_missing_in_single_elements_count_as_empty(spark):
    record = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}, {"content": "x"}]}
    assert chat.Registry().turns(record)[1] == [("user", "q"), ("assistant", ""), ("", "x")]
    assert chat.Registry().turns({"messages": [*MESSAGES, "odd"]})[1] == [*WANT, ("", "")]
    row = chat.format_records(spark.createDataFrame([(1, json.dumps(record))], "record_id long, record string")).first()
    assert row["n_turns"] == 3


def test_a_fingerprint_is_taken_once_for_each_set_of_paths(monkeypatch):
    seen = []
    plain = chat.fingerprint
    registry = chat.Registry()
    monkeypatch.setattr(chat, "fingerprint", lambda of: seen.append(1) or plain(of))
    for k in range(50):
        assert registry.turns({"role": "user", "text": str(k)})[1] == [("user", str(k))] and registry.turns({"messages": MESSAGES})[1] == WANT
    assert len(seen) == 2
