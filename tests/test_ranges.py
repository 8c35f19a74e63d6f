"""Exact quantiles and neighbours at any skew, against brute force; the plans hold no window over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators import profile, report
from rillstone.shared import Scratch


def brute_quantile(values, share):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    return known[max(math.ceil(round(share * len(known), 9)), 1) - 1] if known else None


HARD = {
    "ties": [5.0] * 700 + [1.0] * 3, "tiny": [5e-324 * k for k in range(300)] + [1.0], "huge": [1.7e308, -1.7e308, float("inf"), float("-inf"), 0.0] * 40 + [float(k) for k in range(99)],
    "powers": [2.0**k for k in range(-900, 900, 3)], "few": [3.0, None, float("nan"), 1.0], "none": [None, float("nan")],
}


@pytest.mark.parametrize("parts, few", [(1024, 10_000), (64, 20)])
def test_quantiles_of_hard_values(spark, parts, few):
    rng = random.Random(4)
    data = HARD | {"normal": [rng.gauss(0, 1) for _ in range(2000)], None: [rng.expovariate(1) for _ in range(500)]}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = [0.0, 0.25, 0.9]
    got = {(r.g, r.share): r.quantile for r in profile.exact_quantiles(df, "v", shares, ["g"], parts, few).collect()}
    assert got == {(g, s): brute_quantile(vs, s) for g, vs in data.items() for s in shares if g != "none"}
    whole = {r.share: r.quantile for r in profile.exact_quantiles(df, "v", shares, (), parts, few).collect()}
    assert whole == {s: brute_quantile([v for _, v in rows], s) for s in shares}
    assert profile.exact_quantiles(df.limit(0), "v", shares, ["g"]).count() == 0


def test_fences_and_cadence_without_accuracy(spark):
    rows = [(k % 3 if k % 7 else None, float((k * 37) % 101)) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, gap_min double")
    for groups in ([], ["g"]):
        exact, near = (sorted(map(str, profile.fences(df, "gap_min", groups, accuracy=a).collect())) for a in (None, 1_000_000))
        assert exact == near
        exact, near = (sorted(map(str, profile.cadence(df, groups, accuracy=a).collect())) for a in (None, 1_000_000))
        assert exact == near


@pytest.mark.parametrize("rows", [7, 60, 10_000])
def test_neighbours_of_one_station_with_all_rows(spark, rows):
    """One station holds nearly all rows; nulls, ties and a null group too. The same as one window over each group."""
    rng = random.Random(1)
    data = [(1 if k % 20 else (None if k % 40 else 2), rng.choice([None, *range(200)]), k, rng.choice([None, True, False])) for k in range(600)]
    df = spark.createDataFrame(data, "g int, t int, k int, flag boolean").repartition(5)
    got = profile.with_neighbours(df, ["g"], ["t", "k"], {"k_before": "k", "flag_before": "flag"}, {"t_after": "t"}, rows=rows)
    order, want = {}, []
    for r in sorted(data, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        order.setdefault(r[0], []).append(r)
    for g in order.values():
        for i, r in enumerate(g):
            want.append((*r, g[i - 1][2] if i else None, g[i - 1][3] if i else None, g[i + 1][1] if i + 1 < len(g) else None))
    assert got.columns == ["g", "t", "k", "flag", "k_before", "flag_before", "t_after"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    alone = profile.with_neighbours(df, [], ["t", "k"], {}, {"next": "k"}, rows=rows).collect()
    by = sorted(data, key=lambda r: (-1 if r[1] is None else r[1], r[2]))
    assert {r.k: r.next for r in alone} == {r[2]: (by[i + 1][2] if i + 1 < len(by) else None) for i, r in enumerate(by)}


def test_ranges_bound_what_a_task_sorts(spark):
    """A group that holds every row is spread over ranges, none far above the rows asked for."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), "id")
    got = profile.with_neighbours(df, ["g"], ["id"], {"before": "id"}, rows=2000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__range" in plan and got.filter("before = id - 1").count() == 19_999
    path = plan.split("rillstone/ranges-")[1].split("]")[0].split(",")[0] if "rillstone/ranges-" in plan else None
    sizes = [r["count"] for r in spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("__range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 5000, path


def test_frequency_reads_the_readings_twice(spark):
    """All six facets come from two small tables."""
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-02 00:00:00"), ("b", None)], "s string, t string").withColumn("t", F.to_timestamp("t"))
    step = Scratch(spark)
    found = report.frequency(df, "t", "s", accuracy=None, into=step)
    assert len(step.paths) == 2
    for facet in found.values():
        files = facet.inputFiles()
        assert files and all("rillstone/" in f for f in files)
    assert found["coverage"].first()["n"] == 4 and found["cadence"].first()["median_gap"] == 10.0
    step.clear()


def test_sketches_of_days_answer_any_span(spark):
    """Within three standard errors of the exact number; the union of parts is as good as one sketch of all."""
    df = spark.range(400_000).select((F.col("id") % 3).alias("g"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 10 * 86_400).alias("t"), (F.col("id") * 7 % 90_000).alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, None, 5), (1, None, None)], df.schema))
    s = profile.distinct_sketches(df, "t", "v", ["g"])
    first = df.agg(F.min(F.to_date("t"))).first()[0]
    for a, b in ((0, 9), (2, 4)):
        exact = {r.g: r.n for r in df.filter(F.datediff("t", F.lit(first)).between(a, b)).groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
        days = [f"date_add(date'{first}', {x})" for x in (a, b)]
        got = {r.g: r.n for r in profile.distinct_between(s, *map(F.expr, days), ["g"]).collect()}
        assert got.keys() == exact.keys() and all(abs(got[g] - n) <= 3 * 1.04 / 2 ** (profile.LG / 2) * n for g, n in exact.items())
    assert profile.distinct_between(s, "1999-01-01", "1999-01-02", ["g"]).count() == 0 and profile.distinct_between(s, "1999-01-01", "1999-01-02").first()["n"] == 0
