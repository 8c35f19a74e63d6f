"""Incremental load: new files -> rows -> insert-only merge, each file once.

The checkpoint of the file source is the ledger of files seen; the merge on keys makes a replayed batch harmless, so no state
and no watermark is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.shared import Scratch
from rillstone.sources import readers, sinks


def load_new_files(
    spark: SparkSession, folder: str, schema: T.StructType, name: str, keys: Sequence[str], checkpoint: str, typed: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_a_batch: int = 1000, prune: str | None = None, aside: str | None = None, broken: str | None = None,
) -> None:
    """Reads JSON lines that arrived since the last call and merges them into a table; returns when all are in. ``prune`` and
    ``aside`` are those of the merge: a batch reads only its own range of the table, rows with a null key are put aside. Lines
    that can't be read go to the table ``broken`` (that of the rows with ``_broken`` added, made when there is a first one) with text, file and reason."""

    def merge(batch: DataFrame, _: int) -> None:
        step = Scratch(spark)
        told = step.write(readers.checked(batch, schema), "batch")
        bad = told.filter("reason is not null").select("file", "raw", "reason")
        if not bad.isEmpty():
            sinks.put_broken_aside(bad, broken or f"{name}_broken")
        sinks.merge_insert(typed(told.filter("reason is null").select(*schema.names)), name, keys, prune, aside)
        step.clear()

    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    landed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).filter(F.regexp_like("raw", F.lit(r"\S")))
    query = landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
