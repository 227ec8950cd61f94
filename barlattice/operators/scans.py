"""Scans along a key's rows in order, in memory that does not grow with them.

`streamed` folds sorted rows one by one: for folds whose steps can't be combined (a ledger whose sells take what there
is). A key is one task's work; the task keeps its state, never its rows.

`macd` composes: a run of rows changes the recursive means by an affine map, so each range of rows becomes one map (its
length and where it takes a zero state), and the maps of a key's ranges are applied one after the other. A key's rows may
lie in many ranges, each folded by its own task.

`prior_percentiles` slides over ranges that bring the rows before them along.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barlattice.operators.ranking import numbered
from barlattice.scratch import by_value, stored

by_value(__name__)

ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def streamed(df: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, tuple], tuple], result: str) -> DataFrame:
    """A row per key: the key and the last state. step takes the state and a row's values (the columns of df but for the key, in their order). result: DDL of the key and the state."""
    schema, columns = arrow_schema(result), [c for c in df.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, done = None, None, []
        for batch in batches:
            keys = batch.column(key).to_pylist()
            values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            for k, row in zip(keys, values, strict=True):
                if state is None or k != open_key:
                    if state is not None:
                        done.append((open_key, *state))
                    open_key, state = k, start
                state = step(state, row)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=schema)
                done = []
        if state is not None:
            done.append((open_key, *state))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, result)


def macd_maps(fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    """The step of (fast mean, slow mean, mean of their difference) at a value x: state = matrix @ state + shift * x."""
    f, s, g = (2 / (n + 1) for n in (fast, slow, signal))
    return np.array([[1 - f, 0, 0], [0, 1 - s, 0], [g * (1 - f), -g * (1 - s), 1 - g]]), np.array([f, s, g * (f - s)])


#: Of a key's run of rows: where it starts, its first value, its length, and where it takes a state of zeros.
RUNS = "code string, since double, first double, n long, f double, s double, g double"


def macd_runs(fast: int, slow: int, signal: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (code, at, close) to a row per code and range."""
    schema = arrow_schema(RUNS)
    f, s, g = (2 / (n + 1) for n in (fast, slow, signal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, head, n, mf, ms, mg, done = None, None, 0, 0.0, 0.0, 0.0, []
        for batch in batches:
            for k, at, x in zip(*(batch.column(c).to_pylist() for c in ("code", "at", "close")), strict=True):
                if head is None or k != code:
                    if head is not None:
                        done.append((code, *head, n, mf, ms, mg))
                    code, head, n, mf, ms, mg = k, (at, x), 0, 0.0, 0.0, 0.0
                mf, ms = mf * (1 - f) + x * f, ms * (1 - s) + x * s
                mg = mg * (1 - g) + (mf - ms) * g
                n += 1
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)
                done = []
        if head is not None:
            done.append((code, *head, n, mf, ms, mg))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)

    return run


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, ranges: int | None = None) -> DataFrame:
    """code, dif, dea, hist after the last bar of each code, recursive means that start at its first close (adjust=False). bars: code, trade_date, close, a row per code and day; rows without a close don't count."""
    n = ranges or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(bars.where("close IS NOT NULL").select("code", F.unix_date("trade_date").cast("double").alias("at"), F.col("close").cast("double").alias("close")), "closes")
    runs = rows.repartitionByRange(n, "code", "at").sortWithinPartitions("code", "at").mapInArrow(macd_runs(fast, slow, signal), RUNS)
    matrix, _ = macd_maps(fast, slow, signal)

    def join(state: tuple, run: tuple) -> tuple:
        since, first, length, *moved = run
        before = np.array([first, first, 0.0]) if state[0] is None else np.array(state, dtype=float)
        return tuple((np.linalg.matrix_power(matrix, length) @ before + np.array(moved)).tolist())

    last = streamed(runs, "code", ["since"], (None, None, None), join, "code string, f double, s double, g double")
    dif = F.col("f") - F.col("s")
    return last.select("code", dif.alias("dif"), F.col("g").alias("dea"), ((dif - F.col("g")) * 2).alias("hist"))


#: Rows of a range of a sliding window, and so what a task does at least besides the rows that a range brings along.
RANGE_ROWS = 100_000


def sliding(sizes: tuple[int, ...], least: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by range and place, series by series; each keeps its last values in order of time and of size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, past, ordered = None, {}, {}
        for batch in batches:
            out = [[] for _ in sizes]
            kept = []
            for i, (block, series, own, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_range", "_series", "_own", "_value")), strict=True)):
                if (block, series) != at:
                    at, past, ordered = (block, series), {n: deque() for n in sizes}, {n: [] for n in sizes}
                for j, n in enumerate(sizes):
                    window, line = past[n], ordered[n]
                    if own:
                        below = None if value is None or len(line) < least else bisect.bisect_left(line, value) / len(line) * 100
                        out[j].append(below)
                    if value is not None:
                        bisect.insort(line, value)
                    window.append(value)
                    if len(window) > n:
                        gone = window.popleft()
                        if gone is not None:
                            del line[bisect.bisect_left(line, gone)]
                if own:
                    kept.append(i)
            rows = batch.take(pa.array(kept, type=pa.int64()))
            columns = [rows.column(name) for name in schema.names if name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, type=pa.float64()) for x in out)], schema=schema)

    return run


def prior_percentiles(df: DataFrame, series: str, order: str, value: str, sizes: tuple[int, ...], least: int = 5, range_rows: int = RANGE_ROWS) -> DataFrame:
    """series, order, value and pct<n> for each size: the share of the n rows of the series before this one that are strictly below it, per cent; null with fewer than `least` values. series and value are read as string and double.

    All rows are numbered once along series and order; a range is so many places, and the rows just before it come along, so a
    series may lie in many ranges and a task keeps n values."""
    rows = df.select(F.col(series).cast("string").alias("_series"), F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    placed = numbered(rows, [F.asc("_series"), F.asc("_order")], "_place")
    most, size = max(sizes), F.lit(range_rows)
    here = F.floor((F.col("_place") - 1) / size)
    # the last rows of a range also go to the next one
    until = F.floor((F.col("_place") - 1 + most) / size)
    dealt = placed.withColumn("_range", F.explode(F.sequence(here, until))).withColumn("_own", F.col("_range") == here)
    moved = dealt.repartition("_range").sortWithinPartitions("_range", "_place").select("_range", "_series", "_own", "_value", "_order")
    kinds = {f.name: f.dataType for f in moved.schema.fields}
    names = [f"pct{n}" for n in sizes]
    schema = pa.schema([(c, to_arrow_type(kinds[c], timestamp_utc=True)) for c in ("_series", "_value", "_order")] + [(n, pa.float64()) for n in names])
    ordered = ", ".join([f"{c} {kinds[c].simpleString()}" for c in ("_series", "_value", "_order")] + [f"{n} double" for n in names])
    out = moved.mapInArrow(sliding(sizes, least, schema), ordered)
    return out.select(F.col("_series").alias(series), F.col("_order").alias(order), F.col("_value").alias(value), *[F.round(n, 1).alias(n) for n in names])
