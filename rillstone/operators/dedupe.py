"""Deduplication and insert-only merge.

All rules are total orders, so the row that stays doesn't depend on how the input is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order, then by all other columns."""
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in keys]
    if not order and not rest:
        return df.distinct()
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def latest(df: DataFrame, keys: Sequence[str], updated: str) -> DataFrame:
    """The row updated last (a missing time counts as oldest)."""
    return first_by(df, keys, [F.col(updated).desc_nulls_last()])


def best(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """The row of the highest rank."""
    return first_by(df, keys, [F.col(rank).desc_nulls_last()])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, duplicates (rows beyond the first of each distinct row), share in per cent; a single aggregation."""
    each = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return each.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates")).withColumn(
        "share", F.round(F.try_divide(F.col("duplicates") * 100.0, F.col("rows")), 2)
    )


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) if null_safe else a[k] == b[k] for k in keys])


def to_insert(target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of source, one per key, whose key target lacks. Rows with a null key are left out unless null_safe: they could
    never match, so each run would insert them again (see ``null_keys``)."""
    if not null_safe:
        source = source.dropna(subset=list(keys))
    one = first_by(source, keys, [])
    return one.join(target.select(*keys), _match(one, target, keys, null_safe), "left_anti")


def null_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that a merge puts aside."""
    return source.filter(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys]))


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """target with the rows that an insert-only merge adds."""
    return target.unionByName(to_insert(target, source, keys, null_safe))


def same_bag(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_a, n_b, only_a, only_b (with multiplicity), equal. One aggregation over both instead of two differences."""
    both = a.select(*columns, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*columns, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    each = both.groupBy(*columns).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return each.agg(
        zero(F.sum("a")).alias("n_a"),
        zero(F.sum("b")).alias("n_b"),
        zero(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0)))).alias("only_a"),
        zero(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0)))).alias("only_b"),
    ).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def arbitrate(old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """Per batch (a day), the rows of the side that has more of them; the old side on a tie.

    Sides are counted per batch; the counts, a row per batch, are joined back."""
    sizes = (
        old.select(batch, F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(new.select(batch, F.lit(0).alias("o"), F.lit(1).alias("n")))
        .groupBy(batch)
        .agg((F.sum("n") > F.sum("o")).alias("__new"))
    )
    rows = old.withColumn("__side", F.lit(False)).unionByName(new.withColumn("__side", F.lit(True)))
    return rows.join(sizes, batch).filter("__side = __new").drop("__side", "__new")
