"""Batch loads that take every file once: a ledger of files, written after their rows are in.

A file is known by path, size and time of change, as they were before it was read: one that changes, even while it is read, is new
to the next run. The ledger is written only once the merge is done, so a run that breaks off between the two
loads the same files again, which a merge on keys makes harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rillstone.shared import Scratch
from rillstone.sources import readers, sinks

LEDGER = T.StructType([T.StructField("file", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType())])


def pending(spark: SparkSession, path: str, ledger: str, pattern: str = "*") -> DataFrame:
    """file, size, modified of the files that the ledger doesn't have as they are now."""
    sinks.create_empty(spark, ledger, LEDGER)
    return readers.stats(spark, path, pattern).join(spark.table(ledger), LEDGER.names, "left_anti")


def load(
    spark: SparkSession, path: str, ledger: str, read: Callable[[SparkSession, list[str]], DataFrame], merge: Callable[[DataFrame], None], pattern: str = "*", files_a_batch: int = 1000
) -> int:
    """Reads and merges the files that are new or changed, oldest first, some at a time; returns how many it took. Names and
    stamps of one batch's files pass through the driver."""
    step, taken = Scratch(spark), 0
    waiting = step.write(pending(spark, path, ledger, pattern), "pending")
    while True:
        batch = waiting.join(spark.table(ledger), LEDGER.names, "left_anti").orderBy("modified", "file").limit(files_a_batch).collect()
        if not batch:
            step.clear()
            return taken
        merge(read(spark, [r["file"] for r in batch]))
        sinks.merge_insert(spark.createDataFrame(batch, LEDGER), ledger, LEDGER.names)
        taken += len(batch)
