"""Groups of rows inside sorted partitions, without a pandas frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from barlattice.llm.common import by_value

by_value(__name__)


def equal_next(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row (but the last) has the keys of the next; the keys are integers without nulls."""
    same = np.ones(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        same &= v[1:] == v[:-1]
    return same


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of the groups in them; batches are sorted by keys. A group is held in memory, so its size must be bounded by the caller."""
    kept: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch], last: bool) -> tuple[pa.Table, np.ndarray, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(parts).combine_chunks()
        bounds = np.concatenate([[0], np.flatnonzero(~equal_next(t, keys)) + 1, [t.num_rows]])
        if last:
            return t, bounds, []
        return t.slice(0, int(bounds[-2])), bounds[:-1], t.slice(int(bounds[-2])).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        if kept and all(kept[-1].column(k)[-1] == b.column(k)[b.num_rows - 1] and kept[-1].column(k)[-1] == b.column(k)[0] for k in keys):
            kept.append(b)
            continue
        t, bounds, kept = cut([*kept, b], False)
        if len(bounds) > 1:
            yield t, bounds
    if kept:
        t, bounds, _ = cut(kept, True)
        yield t, bounds


def by_runs(keys: list[str], each: Callable[[pa.Table, int, int], Iterator[dict]], schema: pa.Schema, rows: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: each(table, start, end) yields dicts of arrays for one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        n = 0

        def flush() -> pa.RecordBatch:
            cols = [pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x in out[f.name]], type=f.type).combine_chunks() for f in schema]
            cols = [c if isinstance(c, pa.Array) else c.chunk(0) if c.num_chunks else pa.array([], type=f.type) for c, f in zip(cols, schema, strict=True)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for t, bounds in runs(batches, keys):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for got in each(t, int(a), int(b)):
                    for k, v in got.items():
                        out[k].append(v)
                    n += len(next(iter(got.values())))
                    if n >= rows:
                        yield flush()
                        out, n = {f.name: [] for f in schema}, 0
        if n:
            yield flush()

    return run
