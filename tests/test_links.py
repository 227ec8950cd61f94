import random

from pyspark.sql import functions as F

from barlattice.functions.scalars import BINS
from barlattice.operators import links, needles


def test_themes_industries_and_bounds(spark):
    df = spark.createDataFrame([("a、b,c",), ("x,y+z",), ("nan",), (None,), ("q" * 30,), ("--",)], "t string")
    assert [r[0] for r in df.select(links.theme(F.col("t"))).collect()] == ["a", "x,y", "", "", "q" * 18, "--"]
    assert spark.range(1).select(links.industry(F.lit("abc bank"), [("tech", ["chip"]), ("finance", ["bank"])])).first()[0] == "finance"
    assert ("rps", "<60", None, 60.0) in links.bin_bounds(BINS) and ("rps", "95-100", 95.0, None) in links.bin_bounds(BINS)


def test_json_and_finite(spark):
    df = spark.createDataFrame([('noise {"verdict": "watch", "confidence": 61} end',), ("verdict: avoid, confidence = 40",), ("none",)], "t string")
    assert [(r[0]["verdict"], r[0]["confidence"]) for r in df.select(links.verdict_json(F.col("t"))).collect()] == [("watch", 61.0), ("avoid", 40.0), (None, None)]
    assert [r["x"] for r in links.finite(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")).collect()] == [1.0, None, None]


def test_evidence_scores_and_prices(spark):
    d = spark.createDataFrame([("a", 80.0)], "code string, score double")
    t = spark.createDataFrame([("a", "x"), ("b", "x")], "code string, theme string")
    e = spark.createDataFrame([("x", 90.0)], "theme string, score double")
    assert sorted(map(tuple, links.inherited(d, t, e).collect())) == [("a", "direct", 80.0), ("b", "inherited", 50.0)]
    assert dict(map(tuple, links.fused_score(d, spark.createDataFrame([("a", 60.0), ("c", 10.0)], "code string, score double")).collect())) == {"a": 70.0, "c": 10.0}
    h = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "code string, cost double")
    got = links.price_fallback(h, spark.createDataFrame([("a", 9.0)], "code string, close double"), spark.createDataFrame([("b", 1, 5.0), ("b", 2, 6.0)], "code string, seq long, price double"))
    assert {r["code"]: (r["price"], r["price_source"]) for r in got.collect()} == {"a": (9.0, "spot"), "b": (6.0, "trade"), "c": (3.0, "cost")}


def test_states_overlay_and_factors(spark):
    s = spark.createDataFrame([("g", "a", True, "ok"), ("g", "b", False, "failed"), ("h", "a", True, "failed"), ("k", "a", True, "ok")], "`group` string, source string, critical boolean, status string")
    assert dict(map(tuple, links.status_rollup(s).collect())) == {"g": "degraded", "h": "failed", "k": "ok"}
    base, over = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "k long, v string, n double"), spark.createDataFrame([(1, "", 7.0)], "k long, v string, n double")
    assert sorted(map(tuple, links.overlay(base, over, "k", ["v", "n"]).collect())) == [(1, "x", 7.0), (2, "y", 3.0)]


def test_markdown(spark):
    text = "intro\n## Robots\n| 600001 | up |\nand 1.600002\n### Chips\n000003, 000003\n"
    got = links.markdown_sections(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r["heading"], r["codes"]) for r in got] == [("", []), ("Robots", ["600001"]), ("Chips", ["000003"])]


def test_needles_are_those_of_a_plain_search(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab1é😀") for _ in range(n))
    names = [(f"{k:06d}", word(rnd.randint(1, 6)) if k % 7 else rnd.choice([None, ""])) for k in range(60)]
    docs = [(k if k != 9 else None, None if k == 5 else word(rnd.randint(0, 40)) + (f" {k:06d} " if k % 3 else "")) for k in range(50)] + [(3, "000001"), (3, "000001")]
    want = sorted({(d, c) for d, t in docs for c, n in names if t and (c in t or n and n in t)}, key=str)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "code string, name string")
    for rows in (needles.BROADCAST_ROWS, 0):
        monkeypatch.setattr(needles, "BROADCAST_ROWS", rows)
        assert want and want == sorted(map(tuple, links.news_links(*frames).collect()), key=str)
    assert links.news_links(frames[0], frames[1].limit(0)).count() == 0 and links.news_links(frames[0].limit(0), frames[1]).count() == 0


def test_candidates_carry_no_text(spark):
    docs = spark.createDataFrame([(k, "x" * 50 + f"needle{k}") for k in range(20)], "doc_id long, text string")
    rare = needles.asked(spark.createDataFrame([(str(k), f"needle{k}") for k in range(20)], "code string, needle string"))
    plan = needles.candidates(docs, rare)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert needles.candidates(docs, rare).columns == ["doc_id", "code", "needle"]
