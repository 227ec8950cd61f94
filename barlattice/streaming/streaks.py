"""Streaks across micro-batches: what streak() says of a table, said row by row as rows become certain.

State of a code: its streak so far and the rows that later ones may still precede, packed by batch, not one state row each. When the watermark passes a row's
time, its timer puts the rows up to there in order and says their streaks. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlattice.scratch import by_value

by_value(__name__)

#: Waiting rows: microseconds and values of a batch, as arrays of 8 bytes a row.
ROWS = "ts binary, value binary"
OUT = "code string, ts timestamp, value double, streak long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype("int64")


class Streak(StatefulProcessor):
    """Rows of a code with the number of rows above zero in a row up to each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "n long")
        self.waiting = handle.getListState("waiting", ROWS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendValue((micros(pdf["ts"]).tobytes(), pdf["value"].to_numpy(dtype="float64").tobytes()))
                # one timer for the rows of a batch: they are said together, when the last of them is certain
                self.handle.registerTimer(int(pdf["ts"].max().timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(np.frombuffer(r[0], dtype="int64"), np.frombuffer(r[1], dtype="float64")) for r in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            return
        ts, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((value, ts))
        ts, value = ts[order], value[order]
        ready = int(np.searchsorted(ts, sure, side="right"))
        if ready < len(ts):
            self.waiting.put([(ts[ready:].tobytes(), value[ready:].tobytes())])
        else:
            self.waiting.clear()
        n = self.run.get()[0] if self.run.exists() else 0
        streak = []
        for up in (value[:ready] > 0).tolist():
            n = n + 1 if up else 0
            streak.append(n)
        if ready:
            self.run.update((n,))
            yield pd.DataFrame({"code": key[0], "ts": pd.to_datetime(ts[:ready], unit="us"), "value": value[:ready], "streak": streak})

    def close(self) -> None:
        pass


def streaks(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """code, ts, value, streak of a stream of code, ts, value, each row once the watermark has passed it. The session needs the state store PROVIDER."""
    timed = rows.select("code", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return timed.groupBy("code").transformWithStateInPandas(Streak(), OUT, "Append", "EventTime")
