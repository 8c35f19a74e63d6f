import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone import schemas
from rillstone.operators import analysis, calendar, dedupe, profile, series, shape, star


def tuples(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def readings(spark, rows):
    return spark.createDataFrame(rows, "station string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_unpivot_makes_a_row_a_day(spark):
    cols = [f"Cota{k:02d}" for k in range(1, 32)]
    row = lambda s, d, **v: (s, d, *[v.get(c) for c in cols], "x")
    df = spark.createDataFrame(
        [row("a", "01/02/2023", Cota01="10", Cota30="99", Cota02="", Cota28="1,5"), row("a", "01/01/2023", Cota31="7"), row("b", "01/02/2024", Cota29="2")],
        "EstacaoCodigo string, Data string, " + ", ".join(f"{c} string" for c in cols) + ", Cota01Status string",
    )
    part = lambda i: F.split("Data", "/")[i]
    got = shape.unpivot_days(df, ["EstacaoCodigo"], "Cota", part(2), part(1))
    assert tuples(got.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH"))) == [("a", "2023-01-31 12", "7"), ("a", "2023-02-01 12", "10"), ("a", "2023-02-28 12", "1,5"), ("b", "2024-02-29 12", "2")]


def test_conform_adds_drops_and_nulls(spark):
    df = spark.createDataFrame([("1", "x", 5)], "codigoestacao string, Cota_Adotada string, extra int")
    got = shape.conform(df, schemas.TELEMETRY)
    assert got.columns == schemas.TELEMETRY.names and got.first()["Chuva_Adotada"] is None
    assert shape.rename(df, {"codigoestacao": "station"}).columns == ["station"]


def test_split_valid_puts_nulls_aside(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (None, 1.0)], "k int, v double")
    good, bad = shape.split_valid(df, {"no_key": F.col("k").isNotNull(), "no_value": F.col("v") > 0})
    assert tuples(good) == [(1, 2.0)] and tuples(bad, "reason") == [("no_key",), ("no_value",)]


def test_parse_tokens_wants_twelve(spark):
    lines = ["2023 01 02 03 215 -9999 10132 180 30 0 0 0", "2023 01 02 03 1 2 3 4 5 6 7", "2023 02 30 03 1 2 3 4 5 6 7 8", "  2023  1 2  4  x 1 1 1 1 1 1 1 "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = shape.parse_tokens(df, {"temp": (4, 10.0), "dewp": (5, 10.0)})
    assert tuples(got.withColumn("ts", F.date_format("ts", "HH"))) == [("03", 21.5, None), ("04", None, 0.1)]


def test_merge_case_of_the_notes(spark):
    t = spark.createDataFrame([("a", "t1")], "k string, ts string")
    s = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("b", "t2"), ("c", None)], "k string, ts string")
    once = dedupe.merged(t, s, ["k", "ts"])
    assert tuples(once) == [("a", "t1"), ("b", "t2")] and tuples(dedupe.merged(once, s, ["k", "ts"])) == tuples(once)
    assert tuples(dedupe.null_keys(s, ["k", "ts"]), "k") == [("c",)]
    assert dedupe.merged(dedupe.merged(t, s, ["k", "ts"], True), s, ["k", "ts"], True).count() == 3


def test_latest_is_deterministic(spark):
    rows = [("a", 1, "2023-01-01", 5), ("a", 1, "2023-01-02", 1), ("a", 1, "2023-01-02", 9), ("a", 2, None, 3), ("a", 2, "2020-01-01", 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "s string, k int, upd string, v int").repartition(3)
        assert tuples(dedupe.latest(df, ["s", "k"], "upd"), "k", "v") == [(1, 9), (2, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4) | st.none(), st.integers(0, 2)), max_size=12), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2)), max_size=6))
def test_merge_is_idempotent(spark, source, target):
    s, t = (spark.createDataFrame(x, "k int, v int") for x in (source, target))
    once = dedupe.merged(t, s, ["k"])
    assert tuples(dedupe.merged(once, s, ["k"])) == tuples(once)
    assert {r[0] for r in tuples(once)} == {k for k, _ in source if k is not None} | {k for k, _ in target}


def test_bags_and_arbitration(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert tuple(dedupe.same_bag(a, b, ["k", "v"]).first()) == (3, 3, 1, 1, False)
    assert dedupe.same_bag(a, a, ["k", "v"]).first()["equal"] and dedupe.same_bag(a.limit(0), a.limit(0), ["k", "v"]).first()["equal"]
    old = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1), ("d3", 1)], "d string, v int")
    new = spark.createDataFrame([("d1", 7), ("d2", 8), ("d2", 9), ("d3", 5), ("d4", 1)], "d string, v int")
    assert tuples(dedupe.arbitrate(old, new, "d")) == [("d1", 1), ("d1", 2), ("d2", 8), ("d2", 9), ("d3", 1), ("d4", 1)]


def test_missing_days_add_up(spark):
    df = readings(spark, [("a", "2024-01-01 05:00:00", 1.0), ("a", "2024-01-04 05:00:00", 1.0), ("a", None, 1.0), ("b", "2024-01-02 00:00:00", 1.0)])
    assert [str(r[1]) for r in tuples(calendar.missing_days(df, "ts", ["station"]))] == ["2024-01-02", "2024-01-03"]
    assert tuples(calendar.missing_summary(df, "ts", ["station"])) == [("a", 4, 2, 2, 50.0), ("b", 1, 1, 0, 0.0)]
    assert calendar.missing_summary(df.limit(0), "ts").count() == 0 and calendar.missing_days(df.limit(0), "ts").count() == 0
    filled = calendar.gap_filled(series.daily(df, "ts", "value", ["station"]), ["station"], ["mean"])
    assert filled.count() == 5 and filled.filter("mean is null").count() == 2


def test_gaps_overall_equal_one_window(spark):
    rows = [("a", f"2024-01-{d:02d} {h:02d}:00:00", 1.0) for d in (1, 2, 5) for h in (3, 9, 20)] + [("b", "2024-01-02 09:30:00", 1.0), ("b", None, 1.0)]
    df = readings(spark, rows)
    one = profile.gaps(df.withColumn("all", F.lit(1)), "ts", ["all"], ["station"])
    assert tuples(profile.gaps_by_day(df, "ts", (), ["station"]).fillna(-1), "station", "gap_min") == tuples(one.fillna(-1), "station", "gap_min")
    df = df.withColumn("station", F.when(F.col("station") == "a", "a"))  # a null group too
    a, b = profile.gaps_by_day(df, "ts", ["station"]), profile.gaps(df, "ts", ["station"])
    assert dedupe.same_bag(a, b, b.columns).first()["equal"] and a.count() == 10


def test_rain_without_readings_is_null(spark):
    df = readings(spark, [("a", "2024-01-01 05:00:00", None), ("a", "2024-01-02 05:00:00", 0.0)])
    assert [(r.rain, r.n_readings) for r in series.daily_rain(df, "ts", "value", ["station"]).orderBy("date").collect()] == [(None, 0), (0.0, 1)]


def test_outlier_classes(spark):
    values = [10.0, 11.0, 9.0, 10.0, 90.0, 95.0, 10.0, 11.0, 99.0, 10.0, 9.0, 10.0, 11.0, 10.0, 10.0, 9.0]
    df = readings(spark, [("a", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate(values)])
    got = profile.classify_outliers(profile.flag_outliers(df, "value"), "ts", ["station"])
    assert [(r.value, r.outlier_class) for r in got.filter("is_outlier").orderBy("ts").collect()] == [(90.0, "event"), (95.0, "event"), (99.0, "suspect")]
    assert profile.flag_outliers(df.limit(0), "value").count() == 0


def test_exact_duplicates_of_nothing(spark):
    df = readings(spark, [("a", None, 1.0), ("a", None, 1.0), ("a", None, None)])
    assert tuple(dedupe.exact_duplicates(df).first()) == (3, 1, 33.33)
    assert tuple(dedupe.exact_duplicates(df.limit(0)).first())[:2] == (0, 0)


def test_star_keys_are_stable(spark):
    df = spark.createDataFrame([("a", "n1"), ("a", "n2"), (None, "z"), ("b", None)], "station string, name string")
    d = star.dimension(df, ["station"], ["name"])
    assert tuples(d, "station", "name") == [("a", "n2"), ("b", None)] or {tuple(r) for r in d.select("station", "name").collect()} == {("a", "n2"), ("b", None)}
    assert tuples(d, "key") == tuples(star.dimension(df.repartition(3), ["station"], ["name"]), "key")
    days = spark.createDataFrame([(dt.date(2024, 2, 28),), (dt.date(2024, 3, 1),), (None,)], "date date")
    assert tuples(star.dim_time(days), "time_key") == [(20240228,), (20240229,), (20240301,)]
    assert star.dim_time(days.limit(0)).count() == 0


def test_causality_finds_a_planted_lag(spark):
    import random

    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(300)]
    y = [0.0] + [2 * x[k - 1] + rng.gauss(0, 0.1) for k in range(1, 300)]
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(k), x[k], y[k]) for k in range(300)], "date date, temp double, level double").withColumn("s", F.lit("a"))
    f = series.lagged(series.lagged(df, ["s"], "date", "temp", [1]), ["s"], "date", "level", [1])
    r = analysis.causality(f, ["level_lag1"], ["temp_lag1"], "level").first()
    assert r.f > 1000 and (r.df1, r.df2) == (1, r.n - 3)
    corr = {r.lag: r["corr"] for r in analysis.lag_correlation(analysis.pairs_at_lags(df, "date", "temp", "level", [0, 1, 2])).collect()}
    assert corr[1] > 0.99 and abs(corr[0]) < 0.3
    m = {r.term: r.coefficient for r in analysis.lag_model(f, ["temp_lag1"], "level").collect()}
    assert abs(m["temp_lag1"] - 2) < 0.05


def test_records_of_wide_matrices(spark):
    levels = spark.createDataFrame([("1", "01/02/2023", "5", None)], "EstacaoCodigo string, Data string, Cota01 string, Cota02 string")
    got = shape.level_records(levels)
    assert got.columns == schemas.TELEMETRY.names
    r = got.first()
    assert (r.codigoestacao, r.Cota_Adotada, r.Cota_Adotada_Status, r.Chuva_Adotada, r.Data_Hora_Medicao) == ("1", "5", "0", None, "2023-02-01 12:00:00")
    rain = spark.createDataFrame([("1", "1", "01/02/2023", "5,5"), ("1", "2", "01/02/2023", "7,5"), ("1", "1", "01/03/2023", "1")], "EstacaoCodigo string, NivelConsistencia string, Data string, Chuva01 string")
    assert tuples(shape.rain_records(rain), "Data_Hora_Medicao", "Chuva_Adotada") == [("2023-02-01 12:00:00", "7,5"), ("2023-03-01 12:00:00", "1")]


def test_reports_hold_their_facets(spark):
    from rillstone.operators import report

    df = readings(spark, [("a", f"2024-01-{d:02d} {h:02d}:00:00", float(h)) for d in (1, 2, 4) for h in range(6)] + [("b", "2024-01-04 00:00:00", 900.0)] * 2)
    f = report.frequency(df, "ts", "station")
    assert f["coverage"].first().n == 20 and f["mean_rows_per_day"].first().mean_rows == 6.67 and f["top_gaps"].first().minutes == 60
    assert [str(r[0]) for r in report.missing(df, "ts")["first_gaps"].collect()] == ["2024-01-03"]
    d = report.duplicates(df, ["station", "ts"])
    assert d["exact"].first().duplicates == 1 and d["keys"].first().n_keys == 1
    o = report.outliers(df, "value", "ts", "station")
    assert o["summary"].first().outliers == 2 and o["top"].first().value == 900.0
    assert {r.station: r.outliers for r in o["by_station"].collect()} == {"a": 0, "b": 2}
