"""Scalar functions of the readings model: tolerant parsing, time arithmetic, units.

Everything is a built-in column expression. Parsing never raises: what can't be read is null, and the caller counts or
quarantines it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DAY = "yyyy-MM-dd"


def to_ts(c: Column, fmt: str | None = None) -> Column:
    """string -> timestamp, null if unreadable."""
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def epoch_or_iso(c: Column) -> Column:
    """Epoch seconds or an ISO instant, as strings -> timestamp."""
    return F.coalesce(F.timestamp_seconds(c.try_cast("bigint")), F.try_to_timestamp(c))


def from_epoch(c: Column) -> Column:
    return F.timestamp_seconds(c)


def to_epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def minutes_between(earlier: Column, later: Column) -> Column:
    """Minutes as a double, exact to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def noon(year: Column, month: Column, day: Column) -> Column:
    """Timestamp at 12:00 from the parts of a date; an impossible date is null."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" 12:00:00"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def on_hour(year: Column, month: Column, day: Column, hour: Column) -> Column:
    return F.try_make_timestamp(year, month, day, hour, F.lit(0), F.lit(0))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, ISO_Z)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, DAY)


def day_sequence(first: Column, last: Column) -> Column:
    """Array of all days from first to last."""
    return F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day"))


def part(c: Column, pattern: str, i: int) -> Column:
    """The i-th part (from 0) of a split string, null if there is none."""
    return F.get(F.split(c, pattern), i)


def decimal_comma(c: Column) -> Column:
    """'12,3' -> 12.3, null if it is no number."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32.0) * 5.0 / 9.0


def hectopascal(inches: Column) -> Column:
    """Inches of mercury; the factor is a fixed value, the one that the feeds use."""
    return inches * 33.8639


def sentinel(c: Column, missing: str = "-9999", scale: float | None = None) -> Column:
    """A number as text, null where it is the sentinel, divided by scale."""
    value = F.nullif(c, F.lit(missing)).try_cast("double")
    return value / F.lit(float(scale)) if scale else value


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs])


def signature(*cs: Column) -> Column:
    """The SHA-256 of a record's fields, null-safe and in order: two records with the same one are taken as equal."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in cs])), 256)


def share(part_: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage, rounded; null if the whole is 0."""
    return F.round(F.try_divide(part_ * 100.0, whole), digits)


def outside(c: Column, low: Column, high: Column) -> Column:
    return (c < low) | (c > high)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def target_day(now: Column) -> Column:
    """The day before, for loads that run after midnight."""
    return F.date_sub(F.to_date(now), 1)


def lookback_hours(now: Column, since: Column, least: int = 24, most: int = 72) -> Column:
    """Hours a feed has to be asked for to reach back to since, within bounds."""
    hours = F.ceil((F.unix_micros(now) - F.unix_micros(since)) / F.lit(3_600_000_000.0))
    return F.greatest(F.lit(least), F.least(F.lit(most), hours)).cast("int")
