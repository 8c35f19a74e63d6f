"""Star schema: time, location and source dimensions around a fact of one row per point and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_of(*natural: str):
    """A surrogate key: a 64-bit hash of the natural key, the same on every run."""
    return F.xxhash64(*natural)


def dim_time(dates: DataFrame, date: str = "date") -> DataFrame:
    """A row per calendar day between the first and last date: time_key (yyyymmdd), parts, season of the south."""
    days = dates.agg(F.min(date).alias("a"), F.max(date).alias("b")).filter("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date"))
    month = F.month("date")
    season = F.when(month.isin(12, 1, 2), "summer").when(month.isin(3, 4, 5), "autumn").when(month.isin(6, 7, 8), "winter").otherwise("spring")
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("time_key"), "date", F.year("date").alias("year"), month.alias("month"),
        F.dayofmonth("date").alias("day"), (F.weekday("date") + 1).alias("iso_dow"), F.quarter("date").alias("quarter"), season.alias("season"),
    )


def dimension(df: DataFrame, natural: Sequence[str], attributes: Sequence[str] = (), key: str = "key", updated: str | None = None) -> DataFrame:
    """A row per natural key with its hash key and its attributes (SCD 1): those of one version, the one of the latest ``updated`` (a
    missing time counts as oldest) and of several at that time, or without it, the greatest. No row mixes versions."""
    rows = df.dropna(subset=list(natural))
    kept = [*([updated] if updated else []), *attributes]
    rows = rows.groupBy(*natural).agg(F.max(F.struct(*kept)).alias("v")).select(*natural, "v.*") if kept else rows.select(*natural).distinct()
    return rows.select(key_of(*natural).alias(key), *natural, *attributes, *([updated] if updated else []))


def fact_daily(level: DataFrame, measures: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """level, left-joined with each measure on its common keys, so a day without rain data has null rain."""
    out = level
    for m in measures:
        out = out.join(m, [k for k in keys if k in m.columns], "left")
    return out


def with_keys(fact: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """fact with the keys of (dimension, natural key, key column); Spark broadcasts a dimension that is small."""
    for dim, natural, key in dims:
        fact = fact.join(dim.select(*natural, key), list(natural), "left")
    return fact
