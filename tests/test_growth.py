"""What grows with the market is dealt narrow, not whole rows."""

import contextlib
import io
import re

from barlattice.operators import needles
from barlattice.plans import evaluation, registry, selection

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Each shuffle of a plan: its number of columns and what it is dealt by."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return [(int(n), by) for n, by in re.findall(r"\) Exchange\nInput \[(\d+)\]:.*\nArguments: (.*)", text.getvalue())]


def test_bars_and_their_windows_need_one_shuffle(spark):
    assert len(exchanges(registry.queries()["ma_features"](spark, SF))) == 1


def test_wide_rows_are_not_shuffled_by_day(spark):
    by_day = [n for n, by in exchanges(selection.wide(spark, SF)) if by.startswith("hashpartitioning(trade_date")]
    assert by_day and max(by_day) <= 4


def test_a_needle_of_many_codes_is_a_candidate_once(spark, monkeypatch):
    met, write = [], needles.stored
    monkeypatch.setattr(needles, "stored", lambda df, tag: met.append((tag, write(df, tag))) or met[-1][1])
    docs = spark.createDataFrame([(1, "a long needle here"), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = needles.find(docs, spark.createDataFrame([(f"c{k}", "long needle") for k in range(50)] + [("x", "not"), ("y", "long noodle")], "code string, needle string"))
    assert sorted(map(tuple, found.collect())) == sorted([(1, f"c{k}") for k in range(50)] + [(2, "x")])
    assert dict(met)["candidates"].where("needle = 'long needle'").count() == 1


def test_a_snapshot_sorts_bars_once(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        registry.queries()["technical_snapshot"](spark, SF).explain()
    assert len(re.findall(r"Sort \[code#\d+ ASC NULLS FIRST, trade_date#\d+ (?:ASC|DESC)", text.getvalue())) == 1


def test_a_journal_ranks_the_days_it_records(spark, monkeypatch):
    ranked, rps = [], evaluation.w.rps
    monkeypatch.setattr(evaluation.w, "rps", lambda f: ranked.append(f) or rps(f))
    registry.queries()["journal_store"](spark, SF)
    months = ranked[0].select("trade_date").distinct()
    assert months.count() == months.selectExpr("trunc(trade_date, 'month')").distinct().count()


def test_calibration_deals_bins_by_day_and_passes_twice_by_code(spark):
    df = registry.queries()["calibration_bins"](spark, SF)
    by_day = [n for n, by in exchanges(df) if by.startswith("hashpartitioning(trade_date")]
    assert by_day and max(by_day) <= 5  # before: 13 columns
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    assert len(re.findall(r"Sort \[trade_date", text.getvalue())) == 1  # before: 2
    assert len(re.findall(r"Window \[.*\], \[code#", text.getvalue())) == 2  # before: 3
