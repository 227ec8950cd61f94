"""Versioned tables switch in one step and notice other writers; the journal is measured as a plain loop measures it."""

import datetime as dt
import json
import random

import pytest

from barlattice.sources import journal
from barlattice.sources.versions import ConcurrentWrite, VersionedTable

SCHEMA = "run_date string, code string, score double"


def table(spark, path):
    return VersionedTable(spark, f"file://{path}/t", ("run_date", "code"), "run_date")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_an_upsert_rewrites_its_partitions_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and t.read() is None and t.upsert(rows(spark, ("d1", "1", 1.0)).limit(0)) == 0
    assert t.upsert(rows(spark, ("d1", "1", 1.0), ("d1", "2", 2.0), ("d2", "1", 3.0))) == 1
    before = t.manifest(1)["parts"]
    assert t.upsert(rows(spark, ("d2", "1", 9.0), ("d3", "5", 5.0))) == 2
    now = t.manifest(2)["parts"]
    assert now["d1"] == before["d1"] and now["d2"] != before["d2"] and set(now) == {"d1", "d2", "d3"}
    assert sorted(map(tuple, t.read().collect())) == [("d1", "1", 1.0), ("d1", "2", 2.0), ("d2", "1", 9.0), ("d3", "5", 5.0)]
    assert sorted(map(tuple, t.read(1).collect())) == [("d1", "1", 1.0), ("d1", "2", 2.0), ("d2", "1", 3.0)]
    assert [r["code"] for r in t.read(parts=["d3"]).collect()] == ["5"] and t.read(parts=["d9"]).count() == 0
    with pytest.raises(ValueError, match="partition"):
        t.upsert(rows(spark, ("../x", "1", 1.0)))


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("d1", "1", 1.0)))
    monkeypatch.setattr(VersionedTable, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        t.upsert(rows(spark, ("d1", "1", 2.0)))
    monkeypatch.undo()
    assert [tuple(r) for r in t.read().collect()] == [("d1", "1", 1.0)]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Another writer commits between write and switch: of other partitions, both stay; of the same, the upsert starts over on its rows."""
    t, plain = table(spark, tmp_path), VersionedTable.write_parts
    t.upsert(rows(spark, ("d1", "1", 1.0)))
    for day, code, want in (("d2", "1", 2), ("d1", "2", 3)):
        writes = []

        def meddled(self, df, day=day, code=code, writes=writes):
            out = plain(self, df)
            writes.append(1)
            if len(writes) == 1:
                other = VersionedTable(self.spark, self.path, self.keys, self.by)
                assert other.commit(other.version() + 1, other.manifest(other.version())["parts"] | plain(other, rows(spark, ("d1", "1", 1.0), (day, code, 7.0))), df.schema)
            return out

        monkeypatch.setattr(VersionedTable, "write_parts", meddled)
        t.upsert(rows(spark, ("d1", "9", 4.0)))
        monkeypatch.undo()
        assert len(writes) == 2 and {("d1", "9", 4.0), (day, code, 7.0), ("d1", "1", 1.0)} <= set(map(tuple, t.read().collect()))
    assert not t.commit(1, {}, rows(spark, ("d1", "1", 1.0)).schema)
    monkeypatch.setattr(VersionedTable, "commit", lambda *_: False)
    with pytest.raises(ConcurrentWrite):
        t.upsert(rows(spark, ("d5", "1", 1.0)))


def test_the_journal_is_measured_as_horizons_mature(spark, tmp_path):
    rnd = random.Random(7)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    bars = [(f"{c:06d}", day(k), x := rnd.uniform(5, 20), x + rnd.uniform(0, 2), x - rnd.uniform(0, 2)) for c in range(4) for k in range(30) if (k + c) % 5]
    marks = [(str(day(k)), str(c), c % 2 == 0, 10.0 if k != 3 else 0.0) for c in range(5) for k in range(0, 28, 3)] + [("2024-01-01", "x", True, 1.0)]
    b = spark.createDataFrame(bars, "code string, trade_date date, close double, high double, low double")
    m = spark.createDataFrame(marks, "run_date string, code string, recommended boolean, close double")
    path = f"file://{tmp_path}/j"
    assert journal.evaluate(spark, path, b, "2024-01-20") is None
    assert journal.record(spark, path, m).count() == len(marks) - 1

    def want(as_of):
        out = {}
        for run, code, _, base in marks:
            if base <= 0 or not code.isdigit() or run >= as_of:
                continue
            past = [x for x in bars if x[0] == code.zfill(6) and run < str(x[1]) <= as_of]
            for n in journal.HORIZONS:
                if len(past) >= n:
                    low = min(x[4] for x in past[:n]) / base - 1
                    out[run, code.zfill(6), n] = (past[n - 1][1], past[n - 1][2] / base - 1, max(x[3] for x in past[:n]) / base - 1, low, min(0.0, low), int(past[n - 1][2] > base))
        return out

    store = journal.tables(spark, path)[1]
    for as_of in ("2024-01-16", "2024-01-17", "2024-01-30"):
        before = store.manifest(store.version())["parts"]
        got = {(r["run_date"], r["code"], r["horizon"]): tuple(r)[3:] for r in journal.evaluate(spark, path, b, as_of).collect()}
        assert got.keys() == want(as_of).keys()
        assert all(got[k] == pytest.approx(v) if not isinstance(v[0], dt.date) else got[k][0] == v[0] and got[k][1:] == pytest.approx(v[1:]) for k, v in want(as_of).items())
        if as_of == "2024-01-17":  # one more day: days whose horizons were complete stay as they were written
            assert any(store.manifest(store.version())["parts"][p] == d for p, d in before.items())
    for r in journal.summary(spark, path, "2024-01-30", days=25, only_recommended=True).collect():
        own = [v for (run, code, n), v in want("2024-01-30").items() if n == r["horizon"] and run >= "2024-01-05" and int(code) % 2 == 0]
        assert r["evaluated"] == len(own) and r["win_rate"] == pytest.approx(sum(v[5] for v in own) / len(own)) and r["total"] == r["recommended"]
    assert json.loads((tmp_path / "j" / "metrics" / "_versions" / "00000001.json").read_text())["parts"]
