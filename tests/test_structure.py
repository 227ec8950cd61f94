import datetime as dt

import pytest

from barlattice.operators import market

DAYS = "trade_date date, limit_up long, limit_down long, broke long, max_streak long, advance long, decline long, strong_share double, sd double, ups long, downs long, streak_guess int, seal_guess double, ladder_health double, bull_share double, above_share double, j1 double"


def test_every_weighted_part_counts_and_empty_pools_are_guessed(spark):
    assert len(market.STRUCTURE) == 11 and sum(market.STRUCTURE.values()) == pytest.approx(1)
    day = lambda k: dt.date(2024, 1, k)
    rows = [
        (day(1), 40, 6, 10, 6, 60, 40, 0.05, 4.5, 99, 99, 5, 0.1, 75.0, 0.3, 0.65, 0.4),
        (day(2), 0, 0, 0, None, 60, 40, 0.05, 3.0, 80, 30, 4, 0.5, None, 0.3, 0.65, 0.4),
        (day(3), 0, 1, 0, None, 0, 0, None, None, 0, 0, 1, 0.0, None, None, None, None),
    ]
    got = {r["trade_date"].day: r for r in market.structure(spark.createDataFrame(rows, DAYS)).collect()}
    assert [got[k]["approximate"] for k in (1, 2, 3)] == [False, True, False]
    both = 0.08 * 60 + 0.09 * 50 + 0.09 * 50 + 0.09 * 85 + 0.08 * 50
    assert got[1]["structure"] == pytest.approx(0.13 * 50 + 0.10 * 85 + 0.09 * 90 + 0.08 * 50 + 0.09 * 80 + 0.08 * 75 + both)
    assert got[2]["structure"] == pytest.approx(0.13 * 85 + 0.10 * 50 + 0.09 * 50 + 0.08 * 100 + 0.09 * 50 + 0.08 * 50 + both)
    missing = 0.08 * 50 + 0.09 * 50 * 3 + 0.08 * 50 + 0.08 * 64 + 0.08 * 50
    assert got[3]["structure"] == pytest.approx(0.09 * (100 - 100 / 60) + missing)


def test_ladder_health_is_proportional(spark):
    levels = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 5), (3, 1, 9), (3, 2, 4)], "trade_date int, streak long, n long")
    assert {r[0]: r[1] for r in market.ladder_health(levels).collect()} == {1: 62.5, 2: 50.0, 3: 100.0}
