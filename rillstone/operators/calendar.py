"""Dense calendars: missing days and gap-filled series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import scalars as S


def observed_days(df: DataFrame, ts: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct (groups, date) with a reading; rows without a time are left out."""
    return df.select(*groups, F.to_date(ts).alias("date")).filter("date is not null").distinct()


def calendar(days: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """All days from the first to the last observed, per group."""
    spans = days.groupBy(*groups).agg(F.min("date").alias("__a"), F.max("date").alias("__b")).filter("__a is not null")
    return spans.select(*groups, F.explode(S.day_sequence(F.col("__a"), F.col("__b"))).alias("date"))


def missing_days(df: DataFrame, ts: str, groups: Sequence[str] = ()) -> DataFrame:
    """Calendar days without a reading."""
    days = observed_days(df, ts, groups)
    return calendar(days, groups).join(days, [*groups, "date"], "left_anti")


def missing_summary(df: DataFrame, ts: str, groups: Sequence[str] = ()) -> DataFrame:
    """Expected, present and missing days and the missing share, per group: counts alone, no calendar is laid out."""
    return (
        observed_days(df, ts, groups)
        .groupBy(*groups)
        .agg(F.count("*").alias("present"), (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("expected"))
        .filter("expected is not null")
        .select(*groups, "expected", "present", (F.col("expected") - F.col("present")).alias("missing"), S.share(F.col("expected") - F.col("present"), F.col("expected")).alias("missing_share"))
    )


def gap_filled(daily: DataFrame, groups: Sequence[str], values: Sequence[str | Column], date: str = "date") -> DataFrame:
    """A row for every day between a group's first and last; days without a reading have null values."""
    dense = calendar(daily.select(*groups, F.col(date).alias("date")), groups)
    return dense.join(daily.select(*groups, F.col(date).alias("date"), *values), [*groups, "date"], "left")
