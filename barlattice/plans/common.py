"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.sources.adapters import BARS_SQL, CHANGES_SQL, FLOWS_SQL, SPOT_SQL, STOCKS_SQL
from barlattice.operators.windows import FEATURES_SQL, RPS_SQL

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register


#: Common table expressions by name, each with those it needs before it.
CTES = {"bars": [BARS_SQL], "flows": [FLOWS_SQL], "stocks": [STOCKS_SQL], "ch": [BARS_SQL, CHANGES_SQL], "spot": [BARS_SQL, CHANGES_SQL, STOCKS_SQL, SPOT_SQL], "feat": [BARS_SQL, FEATURES_SQL], "rps": [BARS_SQL, FEATURES_SQL, RPS_SQL]}


def with_ctes(*names: str, more: str = "") -> str:
    parts = list(dict.fromkeys(p for n in names for p in CTES[n]))
    return "WITH " + ",\n".join([*parts, *([more] if more else [])]) + "\n"


def r(name: str | Column, digits: int = 6, alias: str | None = None) -> Column:
    """Rounded, for comparison; halves and doubles of sums differ in their last bits only."""
    c = F.col(name) if isinstance(name, str) else name
    return F.round(c, digits).alias(alias or name)


def layered(source: str, layers: list[dict[str, str]]) -> str:
    """A subquery that applies layers of expressions one after the other; later ones may replace a column."""
    out, have = f"SELECT * FROM {source}", set()
    for layer in layers:
        again = [k for k in layer if k in have]
        have |= set(layer)
        star = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        out = f"SELECT {star}, " + ", ".join(f"{e} AS {k}" for k, e in layer.items()) + f" FROM ({out})"
    return f"({out})"
