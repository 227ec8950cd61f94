"""Where intermediate tables go, and how functions reach the workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from barlattice.scratch import scratch_dir, scratch_path, stored as materialise

__all__ = ["by_value", "discard", "free_name", "materialise", "scratch_dir", "scratch_path", "small_batches"]


def by_value(module_name: str) -> None:
    """Functions of this module travel with the task, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


#: Batches between the JVM and Python hold at most so many bytes of whole rows (a few blocks, some thousands of texts).
BATCH_BYTES = 12 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows of texts and blocks are large: bound the bytes of Arrow batches in this session, where they aren't bounded tighter already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = scratch_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        inside = jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
        if folder.toUri().getPath().startswith(inside + "/"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
