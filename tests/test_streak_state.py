"""State of the streamed streaks: a row per batch that waits, not per bar."""

import pandas as pd

from barlattice.streaming.streaks import Streak


class Kept:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class One(Kept):
    def get(self):
        return self.rows[0]

    def update(self, row):
        self.rows = [row]


class Handle:
    def getValueState(self, *_):
        return One()

    def getListState(self, *_):
        return Kept()

    def registerTimer(self, _):
        pass


class Mark:
    def __init__(self, day):
        self.day = day

    def getCurrentWatermarkInMs(self):
        return int(pd.Timestamp(self.day).timestamp() * 1000)


def test_a_batch_waits_as_one_row():
    s = Streak()
    s.init(Handle())
    days = pd.date_range("2000-01-01", periods=6)
    for part in ([3, 0, 5], [1, 4, 2]):
        assert not list(s.handleInputRows(("a",), iter([pd.DataFrame({"ts": days[part], "value": [float(k != 3) for k in part]})]), None))
    assert len(s.waiting.rows) == 2
    out = pd.concat(s.handleExpiredTimer(("a",), Mark("2000-01-05"), None))
    assert list(out["ts"]) == list(days[:5]) and list(out["streak"]) == [1, 2, 3, 0, 1]
    assert len(s.waiting.rows) == 1
    out = pd.concat(s.handleExpiredTimer(("a",), Mark("2000-01-06"), None))
    assert list(out["streak"]) == [2] and not s.waiting.rows
