from barlattice.operators import links
from barlattice.plans import registry
from barlattice.sources import adapters


def test_no_stock_is_lost(spark):
    stocks = spark.createDataFrame([("a", "steel"), ("b", "steel makers"), ("c", "banks"), ("d", None)], "code string, board string")
    boards = spark.createDataFrame([("steel",), ("steel makers of the north",)], "board string")
    assert dict(map(lambda r: (r[0], r[2]), links.fuzzy_boards(stocks, boards, unmatched=True).collect())) == {"a": "steel", "b": "steel", "c": None, "d": None}
    sf_dir = "/root/testdata/sf0.01"
    got = registry.queries()["fuzzy_board_match_full"](spark, sf_dir).collect()
    assert len(got) == adapters.stocks(spark, sf_dir).count() and any(r["matched"] is None for r in got) and any(r["matched"] not in (None, r["board"]) for r in got)
