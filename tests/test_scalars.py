from pyspark.sql import functions as F

from rillstone.functions import scalars as S


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_parsing_never_raises(spark):
    t = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    lit = F.lit
    assert one(
        spark, t(S.to_ts(lit("2024-02-30 00:00:00"))), t(S.to_ts(lit("x"))), t(S.epoch_or_iso(lit("631152000"))), t(S.epoch_or_iso(lit("1990-01-01T00:00:00Z"))), t(S.epoch_or_iso(lit("junk")))
    ) == [None, None, "1990-01-01 00:00:00", "1990-01-01 00:00:00", None]
    assert one(spark, S.decimal_comma(lit("12,3")), S.decimal_comma(lit("n/d")), S.decimal_comma(lit(None).cast("string")), S.decimal_comma(lit(" 7 "))) == [12.3, None, None, 7.0]


def test_noon_drops_impossible_dates(spark):
    t = lambda y, m, d: F.date_format(S.noon(F.lit(y), F.lit(m), F.lit(d)), "yyyy-MM-dd HH")
    assert one(spark, t(2023, 2, 28), t(2023, 2, 30), t(2024, 2, 29), t(2023, 4, 31)) == ["2023-02-28 12", None, "2024-02-29 12", None]


def test_units_and_sentinels(spark):
    lit = F.lit
    assert one(spark, S.celsius(lit(212.0)), S.celsius(lit(32.0)), F.round(S.hectopascal(lit(29.92)), 2)) == [100.0, 0.0, 1013.21]
    assert one(spark, S.sentinel(lit("-9999")), S.sentinel(lit("215"), scale=10), S.sentinel(lit("a"))) == [None, 21.5, None]
    assert one(spark, S.nan_to_null(lit(float("nan"))), S.nan_to_null(lit(1.0))) == [None, 1.0]
    assert one(spark, S.first_of(lit(""), lit(None), lit("b")), S.part(lit("a/b"), "/", 1), S.part(lit("a"), "/", 3)) == ["b", "b", None]
    assert one(spark, S.share(lit(1), lit(3)), S.share(lit(1), lit(0))) == [33.33, None]


def test_signature_tells_nulls_apart(spark):
    a, b = one(spark, S.signature(F.lit(None).cast("long"), F.lit(1)), S.signature(F.lit(1), F.lit(None).cast("long")))
    assert a != b


def test_window_arithmetic(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    assert str(one(spark, S.target_day(ts("2024-03-01 05:00:00")))[0]) == "2024-02-29"
    now = ts("2024-03-05 00:00:00")
    assert one(spark, *[S.lookback_hours(now, ts(x)) for x in ("2024-03-04 22:00:00", "2024-03-03 00:30:00", "2024-01-01 00:00:00")]) == [24, 48, 72]
    assert one(spark, S.minutes_between(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:15:30"))) == [15.5]
    assert len(one(spark, S.day_sequence(ts("2024-02-27 10:00:00"), ts("2024-03-01 01:00:00")))[0]) == 4
