"""All registered queries of the equity-screening part."""

from __future__ import annotations

from barlattice.plans import decisions, evaluation, links, market, selection, series
from barlattice.plans.common import Query

MODULES = (series, market, selection, evaluation, links, decisions)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.CATALOGUE.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.CATALOGUE.sql.items()}
