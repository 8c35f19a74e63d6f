"""Data-quality reports: the facets of a profile by name, each a lazy DataFrame; nothing is printed or collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators import calendar, dedupe, profile
from rillstone.shared import Scratch


def tall(report: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All facets as one table: facet, key (its text columns and those named in keys), measure, value; times as seconds."""
    out = []
    for facet, df in report.items():
        named = set((keys or {}).get(facet, ()))
        key = [f.name for f in df.schema if f.name in named or f.dataType == T.StringType()]
        number = lambda f: (F.unix_micros(f.name) / F.lit(1e6) if f.dataType == T.TimestampType() else F.col(f.name).cast("double"))
        measures = [f for f in df.schema if f.name not in key]
        each = df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key"), *[number(f).alias(f.name) for f in measures])
        out.append(each.unpivot("key", [f.name for f in measures], "measure", "value").select(F.lit(facet).alias("facet"), "key", "measure", "value"))
    return reduce(DataFrame.unionByName, out)


def frequency(df: DataFrame, ts: str, station: str, k: int = 5, accuracy: int | None = 10_000, into: Scratch | None = None) -> dict[str, DataFrame]:
    """How often a series reports: coverage, mean rows a day, the commonest rows a day and gaps of its stations.

    The readings are read for a row per day and for their gaps, once each; all facets come from these two tables, which live until ``into`` is cleared."""
    into = into or Scratch(df.sparkSession)
    slim = df.select(station, ts)
    dated = slim.groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    days = into.write(dated, "days")
    gaps = into.write(profile.gaps_ranged(slim, ts, [station]).select(station, "gap_min"), "gaps")
    known = days.filter("date is not null").select("date", "n")
    return {
        "coverage": days.agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")),
        "mean_rows_per_day": profile.days_mean(known),
        "top_rows_per_day": profile.top(profile.days_histogram(known), k, F.desc("days"), "n"),
        "top_gaps": profile.top(profile.gap_histogram(gaps), k, F.desc("n"), "minutes"),
        "cadence": profile.cadence(gaps, (), accuracy),
        "cadence_by_station": profile.cadence(gaps, [station], accuracy),
    }


def missing(df: DataFrame, ts: str, k: int = 10) -> dict[str, DataFrame]:
    """Expected, present and missing days of the whole series, and its first gaps."""
    return {"summary": calendar.missing_summary(df, ts), "first_gaps": profile.top(calendar.missing_days(df, ts), k, "date")}


def duplicates(df: DataFrame, keys: Sequence[str], k: int = 5) -> dict[str, DataFrame]:
    repeated = dedupe.duplicate_keys(df, keys)
    return {"exact": dedupe.exact_duplicates(df), "keys": repeated.agg(F.count("*").alias("n_keys")), "top_keys": profile.top(repeated, k, F.desc("n"), *keys)}


def outliers(df: DataFrame, value: str, ts: str, station: str, fence: float = 1.5, accuracy: int = 10_000, k: int = 10) -> dict[str, DataFrame]:
    """Tukey fences, the share beyond them, in all and per station, and the largest. Values are flagged, not deleted."""
    flagged = profile.flag_outliers(df.filter(F.col(value).isNotNull()), value, (), fence, accuracy)
    by = flagged.groupBy(station).agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers"))
    return {
        "summary": profile.outlier_summary(flagged),
        "by_station": by,
        "top": profile.top(flagged.filter("is_outlier").select(station, ts, value), k, F.desc(value), station, ts),
    }
