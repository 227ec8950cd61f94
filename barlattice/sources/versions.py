"""Parquet tables that change partition by partition, with versions that are switched in one step.

A version is a small file that names the folder of every partition's rows. An upsert rewrites the partitions that it touches,
beside the old ones, and then claims the next version's name: readers see the old version or the new one, and a writer that dies
before leaves the old one. A claim fails if another writer was first; the upsert then goes on from that version if
none of its own partitions changed, else it starts over. Files go through Hadoop's file systems, so any store will do whose renames
refuse to replace a file.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSIONS = "_versions"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of old with the same keys; null keys are equal."""
    on = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, on, "left_anti").unionByName(new)


class ConcurrentWrite(RuntimeError):
    """Other writers were first, again and again."""


@dataclass(frozen=True)
class VersionedTable:
    """keys: the columns that name a row; by: the column whose values are the partitions (letters, digits, - and _)."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    by: str

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The last version; 0 without any."""
        fs, home = self._files(f"{self.path}/{VERSIONS}")
        names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
        return max((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)

    def manifest(self, version: int) -> dict:
        if not version:
            return {"parts": {}, "schema": None}
        text = self.spark.read.text(f"{self.path}/{VERSIONS}/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """The rows of a version (the last one), or of some of its partitions only; None before the first."""
        found = self.manifest(self.version() if version is None else version)
        if found["schema"] is None:
            return None
        schema = StructType.fromJson(found["schema"])
        folders = [f"{self.path}/{d}" for p, d in found["parts"].items() if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write_parts(self, rows: DataFrame) -> dict[str, str]:
        """New folders for the partitions of rows, in no version yet."""
        folder = f"data/{uuid.uuid4().hex}"
        # a large partition is split over several files
        rows.withColumn("_part", F.col(self.by).cast("string")).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        fs, home = self._files(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(home)]
        return {n.removeprefix("_part="): f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def commit(self, version: int, parts: dict[str, str], schema: StructType) -> bool:
        """Make this the version of that number; False if there is one already."""
        fs, draft = self._files(f"{self.path}/{VERSIONS}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"parts": parts, "schema": json.loads(schema.json())}).encode()))
        out.close()
        sc = self.spark.sparkContext
        jvm = sc._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{VERSIONS}/{version:08d}.json")
        rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = rename.getEnumConstants()[0]
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(draft, target, how)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def upsert(self, rows: DataFrame, attempts: int = 5) -> int:
        """rows replace those with their keys; returns the new version. Only partitions that rows touch are read and written. rows must have one row per key."""
        touched = [r[0] for r in rows.select(F.col(self.by).cast("string")).distinct().collect()]
        if bad := [t for t in touched if t is None or not re.fullmatch(r"[\w-]+", t)]:
            raise ValueError(f"no partition can be named {bad[:3]}")
        if not touched:
            return self.version()
        fresh, base = None, {}
        for _ in range(attempts):
            version = self.version()
            now = self.manifest(version)
            if fresh is None or any(now["parts"].get(t) != base.get(t) for t in touched):
                old = self.read(version, touched)
                base, fresh = now["parts"], self.write_parts(rows if old is None else upsert(old, rows.select(*old.columns), list(self.keys)))
            if self.commit(version + 1, now["parts"] | fresh, rows.schema if now["schema"] is None else StructType.fromJson(now["schema"])):
                return version + 1
        raise ConcurrentWrite(self.path)
