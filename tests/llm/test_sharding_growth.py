"""What grows with the number of slots does not pass through the driver."""

import contextlib
import io

from barlattice.llm import sharding


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_the_directory_is_joined_without_broadcasts(spark, monkeypatch):
    plans, write = {}, sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df, tag: (plans.update({tag: plan_of(df)}), write(df, tag))[1])
    monkeypatch.setattr(sharding, "BROADCAST_SLOTS", 100)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(CAST(id AS STRING), 20) AS text")
    out = sharding.assign_shards(docs, 500)
    assert "SortMergeJoin" in plans["directory"] and "Broadcast" not in plans["directory"]
    assert "Broadcast" not in plan_of(out) and out.count() == 3000
