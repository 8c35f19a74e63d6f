"""What the operators of this subpackage share: tables between steps, bounded Arrow batches, joins, the words of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.shared import Scratch, materialize, new_path, shared_dir, table

__all__ = ["WORDS", "Scratch", "bounded_batches", "join_split", "materialize", "new_path", "shared_dir", "small", "table"]

WORDS = r"[^\x20\x09-\x0D]+"
#: A key with more than this share of all rows, and HOT_ROWS, is joined map-side; there are at most 1 / SHARE of them.
SHARE = 1e-3
HOT_ROWS = 1000
#: A table of at most so many short rows is broadcast.
BROADCAST_ROWS = 1_000_000


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Keeps Arrow batches small where the session doesn't set their size, as texts may be long."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(size)),
    ):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows; Spark chooses otherwise. Counted first, so df should be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_split(rows: DataFrame, of: DataFrame, key: str, share: float = SHARE, floor: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """rows with the columns of ``of``, which has one row a key and in ``rows`` how many rows that key has at most.

    Keys above the share (and the floor) are joined where their rows lie, all others by a shuffle, so no task gets a hot key's rows.
    ``total``, where it is known, says how many rows there are at most.
    """
    if total is not None and total <= floor:
        return rows.join(of.drop("rows"), key)
    most, total = of.agg(F.max("rows"), F.sum("rows")).first()
    limit = max(floor, share * (total or 0))
    if (most or 0) <= limit:
        return rows.join(of.drop("rows"), key)
    heavy = F.broadcast(of.filter(F.col("rows") > limit).drop("rows"))  # at most 1 / share rows
    cold = rows.join(heavy.select(key), key, "left_anti").join(of.filter(F.col("rows") <= limit).drop("rows"), key)
    return cold.unionByName(rows.join(heavy, key).select(*cold.columns))
