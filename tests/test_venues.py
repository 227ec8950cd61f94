"""Pools by venue, with codes past those of the test tables."""

import datetime as dt
from collections import defaultdict

import pandas as pd

from barlattice.plans import registry


def items(path, rows):
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_returnflag l_shipdate".split()
    pd.DataFrame(rows, columns=columns).astype({"l_shipdate": "datetime64[us]"}).to_parquet(path / "lineitem.parquet")


def test_venue_pools_take_codes_whose_product_is_beyond_an_int(spark, tmp_path):
    prices, codes = [100.0, 112.0, 135.0, 120.0, 95.0, 200.0], [7, 58_467, 59_999, 300_001, 999_999]
    items(tmp_path, [(d * 10 + k, 1, c, 1, 1.0, p * (k + 1), "N", dt.datetime(2000, 1, 1) + dt.timedelta(days=d)) for k, c in enumerate(codes) for d, p in enumerate(prices)])
    want = defaultdict(lambda: [0, 0])
    for c in codes:
        up = 19.5 if f"{c * 36_731 % 1_000_000:06d}"[:2] in ("30", "68") else 9.5
        for d in range(1, len(prices)):
            change = prices[d] / prices[d - 1] * 100 - 100
            day = want[dt.date(2000, 1, 1) + dt.timedelta(days=d), up]
            day[0] += change >= up
            day[1] += change <= -up
    got = {(r["trade_date"], r["up"]): [r["limit_up"], r["limit_down"]] for r in registry.queries()["venue_pools"](spark, str(tmp_path)).collect()}
    assert got == dict(want)
