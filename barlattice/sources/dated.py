"""Folders of dated files as a Spark data source: quote lines or Parquet snapshots under <path>/<by>=<value>/.

    register(spark)
    spark.read.format("dated").option("path", p).option("by", "trade_date").load().where("trade_date >= '2024-01-02'")

A file, or a piece of a file of lines, is a partition. Comparisons of the dated column with values are pushed to the source, which
then lists and opens only the folders that pass; other filters stay with Spark. Options: path (a folder that all workers can open), by,
kind (lines: a column `value` with each line; parquet: the columns of `fields`), fields (DDL, for parquet), split (bytes of a piece of lines).
"""

from __future__ import annotations

import operator
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from barlattice.scratch import by_value

by_value(__name__)

SPLIT = 64 << 20
ROWS = 65_536
#: Filters that the source decides alone; dates are compared as ISO strings.
TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}


@dataclass
class Piece(InputPartition):
    path: str
    day: str
    start: int = 0
    end: int | None = None


class DatedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.home, self.by = urlparse(options["path"]).path, options["by"]
        self.lines, self.split = options.get("kind", "lines") == "lines", int(options.get("split", SPLIT))
        self.columns = [f.name for f in schema.fields]
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == (self.by,):
                self.tests.append((TESTS[type(f)], tuple(map(str, f.value)) if isinstance(f, In) else str(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name in sorted(os.listdir(self.home)):
            key, _, day = name.partition("=")
            day = unquote(day)
            if key != self.by or not all(test(day, value) for test, value in self.tests):
                continue
            for file in sorted(os.listdir(f"{self.home}/{name}")):
                path = f"{self.home}/{name}/{file}"
                if file.startswith((".", "_")) or not os.path.getsize(path):
                    continue
                size = os.path.getsize(path) if self.lines else 1
                out += [Piece(path, day, a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(piece, Piece):  # a source without any partition is read once, for nothing
            return
        for columns in self.of_lines(piece) if self.lines else self.of_parquet(piece):
            n = len(next(iter(columns.values()))) if columns else 0
            columns[self.by] = pa.array([piece.day] * n, type=pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], names=self.columns)

    def of_lines(self, piece: Piece) -> Iterator[dict]:
        """The lines that start inside the piece."""
        with open(piece.path, "rb") as f:
            if piece.start:
                f.seek(piece.start - 1)
                f.readline()
            rows: list[str] = []
            while f.tell() < piece.end and (line := f.readline()):
                rows.append(line.rstrip(b"\r\n").decode(errors="replace"))
                if len(rows) >= ROWS:
                    yield {"value": pa.array(rows, type=pa.string())}
                    rows = []
            if rows:
                yield {"value": pa.array(rows, type=pa.string())}

    def of_parquet(self, piece: Piece) -> Iterator[dict]:
        file = pq.ParquetFile(piece.path)
        for batch in file.iter_batches(ROWS, columns=[c for c in self.columns if c != self.by]):
            yield dict(zip(batch.schema.names, batch.columns, strict=True))


class Dated(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dated"

    def schema(self) -> str:
        return f"{self.options['fields'] if self.options.get('kind') == 'parquet' else 'value string'}, {self.options['by']} string"

    def reader(self, schema: StructType) -> DatedReader:
        return DatedReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Dated)
