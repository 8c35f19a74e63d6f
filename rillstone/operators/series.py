"""Daily series: aggregates, quality grades, completeness, lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(df: DataFrame, ts: str, value: str, groups: Sequence[str]) -> DataFrame:
    """A row per group and day: mean, min, max, sum (null without a value, never 0) and n_readings. Mixed cadences meet here."""
    return (
        df.withColumn("date", F.to_date(ts))
        .filter("date is not null")
        .groupBy(*groups, "date")
        .agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("n_readings"))
    )


def daily_level(df: DataFrame, ts: str, value: str, groups: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Mean and greatest level a day; scale turns the unit of the readings into the one wanted."""
    d = daily(df, ts, value, groups)
    return d.select(*groups, "date", (F.col("mean") * scale).alias("level_mean"), (F.col("max") * scale).alias("level_max"), "n_readings")


def daily_temperature(df: DataFrame, ts: str, value: str, groups: Sequence[str]) -> DataFrame:
    return daily(df, ts, value, groups).select(*groups, "date", F.col("mean").alias("temp_mean"), F.col("min").alias("temp_min"), F.col("max").alias("temp_max"), "n_readings")


def daily_rain(df: DataFrame, ts: str, value: str, groups: Sequence[str]) -> DataFrame:
    return daily(df, ts, value, groups).select(*groups, "date", F.col("sum").alias("rain"), "n_readings")


def day_quality(df: DataFrame, ts: str, value: str, groups: Sequence[str], good: int = 12, fair: int = 4) -> DataFrame:
    """Readings, distinct hours, spread and longest silence (minutes, within the day) of each day, and a grade: A with at
    least ``good`` hours seen, B with ``fair``, else C."""
    w = Window.partitionBy(*groups, "date").orderBy(ts)
    d = df.withColumn("date", F.to_date(ts)).filter("date is not null")
    d = d.withColumn("__gap", (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / F.lit(60_000_000.0))
    return (
        d.groupBy(*groups, "date")
        .agg(F.count(value).alias("n_readings"), F.count_distinct(F.hour(ts)).alias("hours"), F.stddev_pop(value).alias("spread"), F.max("__gap").alias("longest_gap"))
        .withColumn("grade", F.when(F.col("hours") >= good, "A").when(F.col("hours") >= fair, "B").otherwise("C"))
    )


def completeness(df: DataFrame, ts: str, station: str) -> DataFrame:
    """Observed days over days of the whole series' span, per station."""
    days = df.select(station, F.to_date(ts).alias("date")).filter("date is not null")
    span = days.agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("span"))
    each = days.distinct().groupBy(station).agg(F.count("*").alias("days"))
    return each.join(F.broadcast(span), F.lit(True)).select(station, "days", F.col("span").cast("long").alias("span"), (F.col("days") / F.col("span")).alias("score"))


def select_stations(df: DataFrame, ts: str, station: str, least: float) -> DataFrame:
    """Rows of the stations whose completeness is at least ``least``."""
    return df.join(completeness(df, ts, station).filter(F.col("score") >= least).select(station), station, "left_semi")


def lagged(dense: DataFrame, groups: Sequence[str], date: str, value: str, lags: Sequence[int]) -> DataFrame:
    """dense with value_lag1, ...; a lag of k is k days only on a gap-filled series."""
    w = Window.partitionBy(*groups).orderBy(date)
    return dense.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in lags})
