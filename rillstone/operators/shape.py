"""Projection, conformance and reshaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone import schemas
from rillstone.functions import scalars as S
from rillstone.operators import dedupe


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the named columns, under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: missing ones null, others dropped, values that don't fit null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def with_constants(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(values))


def numbered_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns named prefix and two digits, so 'Chuva01' but not 'Chuva01Status'."""
    return [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d{2}", c)]


def unpivot_days(df: DataFrame, ids: Sequence[str], prefix: str, year: Column, month: Column, value: str = "value") -> DataFrame:
    """A row per station-month with a column per day -> a row per day: ids, ts at noon, value.

    Empty values and impossible dates are dropped. One narrow pass, without a shuffle."""
    days = numbered_columns(df, prefix)
    kept = df.select(*ids, year.cast("int").alias("__y"), month.cast("int").alias("__m"), *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in days])
    long = kept.unpivot([*ids, "__y", "__m"], days, "__day", value)
    return (
        long.filter(F.col(value).isNotNull())
        .withColumn("ts", S.noon(F.col("__y"), F.col("__m"), F.regexp_extract("__day", r"(\d{2})$", 1)))
        .filter("ts is not null")
        .select(*ids, "ts", value)
    )


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with ``reason``, the first check that fails)."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    told = df.withColumn("reason", reason)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def on_day(df: DataFrame, ts: str, day: Column) -> DataFrame:
    """Rows of one day, as a range on the typed column, which a scan can push down."""
    start = F.to_date(day).cast("timestamp")
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))


def between_days(df: DataFrame, ts: str, first, last) -> DataFrame:
    """Rows of the whole days from that of first to that of last (times); none if these are null."""
    if first is None:
        return df.limit(0)
    day = lambda x: F.to_date(F.lit(x)).cast("timestamp")
    return df.filter((F.col(ts) >= day(first)) & (F.col(ts) < day(last) + F.expr("interval 1 day")))


def since_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    return df.filter(F.col(ts) >= F.make_date(F.lit(year), F.lit(1), F.lit(1)).cast("timestamp"))


def within_bounds(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows whose value is physically possible (null isn't)."""
    return df.filter(F.col(value).between(low, high))


def members(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among those wanted: a semi join, broadcast by Spark if wanted is small."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def parse_tokens(lines: DataFrame, slots: Mapping[str, tuple[int, float | None]], missing: str = "-9999", least: int = 12, column: str = "value") -> DataFrame:
    """White-space separated lines: year month day hour, then integers; slots: name -> (place, divisor).

    Lines with fewer than ``least`` tokens or an impossible time are dropped."""
    t = lines.select(F.split(F.trim(column), r"\s+").alias("t")).filter(F.size("t") >= least)
    at = lambda i: F.get("t", F.lit(i))
    number = lambda i: at(i).try_cast("int")
    return t.select(
        S.on_hour(number(0), number(1), number(2), number(3)).alias("ts"), *[S.sentinel(at(i), missing, scale).alias(name) for name, (i, scale) in slots.items()]
    ).filter("ts is not null")


def conform_surface(df: DataFrame) -> DataFrame:
    """Surface observations as landed (text columns valid, station, tmpf, dwpf, alti, drct, sknt, vsby, lat, lon, metar) ->
    weather records. Temperatures and pressure are converted, wind and visibility kept."""
    ts = S.to_ts(F.col("valid"))
    number = lambda c: S.nan_to_null(F.col(c).try_cast("double"))
    return df.filter(ts.isNotNull() & F.nullif("station", F.lit("")).isNotNull()).select(
        F.col("station").alias("icaoId"),
        S.to_epoch(ts).alias("obsTime"),
        S.iso_z(ts).alias("reportTime"),
        S.celsius(number("tmpf")).alias("temp"),
        S.celsius(number("dwpf")).alias("dewp"),
        number("drct").alias("wdir"),
        number("sknt").alias("wspd"),
        number("vsby").alias("visib"),
        S.hectopascal(number("alti")).alias("altim"),
        number("lat").alias("lat"),
        number("lon").alias("lon"),
        F.col("metar").alias("rawOb"),
    )


def _telemetry(long: DataFrame, station: str, value: str, into: str) -> DataFrame:
    """The 9 text columns of a telemetry record; measures that a source lacks are null, not zero."""
    named = long.select(F.col(station).alias("codigoestacao"), F.col(value).cast("string").alias(into), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Data_Hora_Medicao"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return conform(with_constants(named, {f"{into}_Status": F.lit("0"), "Data_Atualizacao": stamp}), schemas.TELEMETRY)


def level_records(wide: DataFrame, station: str = "EstacaoCodigo", date: str = "Data") -> DataFrame:
    """Monthly level matrix (date dd/MM/yyyy, Cota01..31) -> telemetry records, in one plan."""
    part = lambda i: S.part(F.col(date), "/", i)
    return _telemetry(unpivot_days(wide, [station], "Cota", part(2), part(1), "level"), station, "level", "Cota_Adotada")


def rain_records(wide: DataFrame, station: str = "EstacaoCodigo", date: str = "Data", consistency: str = "NivelConsistencia") -> DataFrame:
    """Monthly rain matrix (Chuva01..31) -> telemetry records; of several versions of a month the most consistent one."""
    part = lambda i: S.part(F.col(date), "/", i)
    ranked = wide.withColumn(consistency, F.col(consistency).try_cast("double"))
    one = dedupe.best(ranked, [station, date], consistency)
    return _telemetry(unpivot_days(one, [station], "Chuva", part(2), part(1), "rain"), station, "rain", "Chuva_Adotada")
