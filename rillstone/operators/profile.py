"""Data-quality profiles of a series; a DataFrame per facet, each from a single scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import scalars as S
from rillstone.shared import Scratch, materialize


def coverage(df: DataFrame, ts: str, groups: Sequence[str] = ()) -> DataFrame:
    """First and last time and rows, in all or per group."""
    return df.groupBy(*groups).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def rows_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of a total order (take-ordered, no full sort)."""
    return df.orderBy(*order).limit(k)


def rows_per_day(df: DataFrame, ts: str) -> DataFrame:
    return df.select(F.to_date(ts).alias("date")).filter("date is not null").groupBy("date").agg(F.count("*").alias("n"))


def rows_per_day_histogram(df: DataFrame, ts: str) -> DataFrame:
    return days_histogram(rows_per_day(df, ts))


def days_histogram(days: DataFrame) -> DataFrame:
    """Days by their number n of rows."""
    return days.groupBy("n").agg(F.count("*").alias("days"))


def mean_rows_per_day(df: DataFrame, ts: str) -> DataFrame:
    return days_mean(rows_per_day(df, ts))


def days_mean(days: DataFrame) -> DataFrame:
    return days.agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.round(F.avg("n"), 2).alias("mean_rows"))


def gaps(df: DataFrame, ts: str, groups: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """df with gap_min, the minutes since the group's reading before (null for its first)."""
    w = Window.partitionBy(*groups).orderBy(ts, *tie)
    return df.filter(F.col(ts).isNotNull()).withColumn("gap_min", S.minutes_between(F.lag(ts).over(w), F.col(ts)))


def gaps_by_day(df: DataFrame, ts: str, groups: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """As ``gaps``, for a whole series or groups of which one may hold much of it: readings follow each other within a day,
    and a day's first follows the last of the group's day before, found among a row per group and day. So no task gets
    more than a day of a group."""
    dated = df.filter(F.col(ts).isNotNull()).withColumn("__day", F.to_date(ts))
    ends = dated.groupBy(*groups, "__day").agg(F.max(ts).alias("__last"))
    order = (Window.partitionBy(*groups) if groups else Window).orderBy("__day")
    before = ends.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__day").alias("__d"), F.lag("__last").over(order).alias("__before"))
    w = Window.partitionBy(*groups, "__day").orderBy(ts, *tie)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.col("__day") == F.col("__d"))
    met = dated.withColumn("__prev", F.lag(ts).over(w)).join(before, same)
    return met.withColumn("gap_min", S.minutes_between(F.coalesce("__prev", "__before"), F.col(ts))).select(*df.columns, "gap_min")


#: Rows of a range: what one task sorts, however many a group has.
RANGE_ROWS = 1_000_000
#: So many ranges at most while each holds no more than RANGE_ROWS, as every task of a shuffle writes a block for each.
RANGES = 400


def with_neighbours(df: DataFrame, groups: Sequence[str], order: Sequence[str], before: Mapping[str, str] = {}, after: Mapping[str, str] = {}, rows: int = RANGE_ROWS) -> DataFrame:
    """df with columns of the row before (new name -> column) and of the row after, in the order within each group.

    Rows are parted into ranges of groups and order, of about ``rows`` each (more where there would be over ``RANGES`` of them), so a group that holds much of the table is spread over tasks. Within
    a range neighbours are a window; a range's first row takes what is before from the last row of the group's range before, found among a row per
    group and range, and its last row likewise. A table of one range needs neither. Rows that agree in groups and order
    stay together, so the order should have a tie-break; nulls come first."""
    total = df.count()
    count = min(-(-total // rows), max(RANGES, -(-total // RANGE_ROWS)))
    if count <= 1:
        w = Window.partitionBy(*groups).orderBy(*order)
        return df.withColumns({**{n: F.lag(c).over(w) for n, c in before.items()}, **{n: F.lead(c).over(w) for n, c in after.items()}})
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    ranged = materialize(df.repartitionByRange(count, *keys).withColumn("__range", F.spark_partition_id()), "ranges")  # written, so that a row's range stays
    w = Window.partitionBy(*groups, "__range").orderBy(*order)
    there = lambda c, f: F.struct(f(c).over(w).alias("v"), f(F.lit(True)).over(w).alias("there"))
    ranged = ranged.withColumns({**{f"__b{i}": there(c, F.lag) for i, c in enumerate(before.values())}, **{f"__a{i}": there(c, F.lead) for i, c in enumerate(after.values())}})
    place = F.struct(*[F.col(c) for c in order])
    carried = lambda cs, pick: F.struct(*[pick(F.struct(F.col(c).alias("v")), place).alias(f"v{i}") for i, c in enumerate(cs)])
    ends = ranged.groupBy(*groups, "__range").agg(*([carried(before.values(), F.max_by).alias("__last")] if before else []), *([carried(after.values(), F.min_by).alias("__first")] if after else []))
    across = Window.partitionBy(*groups).orderBy("__range")  # a row per group and range
    ends = ends.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__range").alias("__r"),
        *([F.lag("__last").over(across).alias("__before")] if before else []), *([F.lead("__first").over(across).alias("__after")] if after else []),
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.col("__range") == F.col("__r"))
    met = ranged.join(ends, same)
    out = {n: F.when(F.col(f"__b{i}.there"), F.col(f"__b{i}.v")).otherwise(F.col(f"__before.v{i}.v")) for i, n in enumerate(before)}
    out |= {n: F.when(F.col(f"__a{i}.there"), F.col(f"__a{i}.v")).otherwise(F.col(f"__after.v{i}.v")) for i, n in enumerate(after)}
    return met.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in out.items()])


def gaps_ranged(df: DataFrame, ts: str, groups: Sequence[str] = (), tie: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """As ``gaps``, for groups (or a whole series) of any size, a day of any size too."""
    met = with_neighbours(df.filter(F.col(ts).isNotNull()), groups, [ts, *tie], before={"__before": ts}, rows=rows)
    return met.withColumn("gap_min", S.minutes_between(F.col("__before"), F.col(ts))).drop("__before")


def gap_histogram(with_gaps: DataFrame) -> DataFrame:
    """Readings by whole minutes of their gap."""
    return with_gaps.filter("gap_min is not null").groupBy(F.floor("gap_min").cast("long").alias("minutes")).agg(F.count("*").alias("n"))


def cadence(with_gaps: DataFrame, groups: Sequence[str] = (), accuracy: int | None = 10_000) -> DataFrame:
    """Least, median and greatest gap and their number, in all or per group; the median is exact where no accuracy is given."""
    if accuracy is None:
        rest = with_gaps.filter("gap_min is not null").groupBy(*groups).agg(F.min("gap_min").alias("min_gap"), F.max("gap_min").alias("max_gap"), F.count("*").alias("n"))
        median = exact_quantiles(with_gaps, "gap_min", [0.5], groups).select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("quantile").alias("median_gap"))
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.lit(True))
        return rest.join(median, same).select(*groups, "min_gap", "median_gap", "max_gap", "n")
    return (
        with_gaps.filter("gap_min is not null")
        .groupBy(*groups)
        .agg(F.min("gap_min").alias("min_gap"), F.percentile_approx("gap_min", 0.5, accuracy).alias("median_gap"), F.max("gap_min").alias("max_gap"), F.count("*").alias("n"))
    )


def presence(expected: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Every expected key: whether it is there and with how many rows. df is counted before it meets the list."""
    counts = df.join(expected.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    return expected.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("found"))


#: Parts that a range of values is split into, and rows of a range that is small enough to be sorted.
PARTS, FEW = 1024, 10_000
#: So many ranges are broadcast.
SPANS = 100_000


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = (), parts: int = PARTS, few: int = FEW) -> DataFrame:
    """groups, share, quantile: the least value that at least such a share of a group's values doesn't exceed (``quantile_disc``), exact at
    any size and skew. Null values and NaN are left out; a group without others gives no row.

    Rank selection: the range of values that holds a rank is split into ``parts``, whose rows are counted where they lie; the part that holds
    the rank becomes the range, until it is one value or has at most ``few`` rows, which are sorted. Every round reads only what
    the round before left, a table of a small share of the rows; per rank, counts of ``parts`` ranges are all that is shuffled."""
    step = Scratch(df.sparkSession)
    v = F.col("v")
    named = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, named, strict=True)], F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    spans = rows.groupBy(*named).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n > 0")
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    spans = spans.select(*named, wanted, "n", "lo", "hi")
    # the rank, from the share as it is written
    rank = F.greatest(F.ceil(F.col("share").cast("decimal(18,9)") * F.col("n").cast("decimal(19,0)")).cast("long"), F.lit(1))
    spans = step.write(spans.select(*named, "share", rank.alias("rank"), F.col("n").alias("m"), "lo", "hi"), "spans")
    keys, one, small = [*named, "share"], F.col("lo") == F.col("hi"), F.col("m") <= few
    # evenly, by halves as the difference of two doubles may pass the greatest, and in turn by order of magnitude, as values may lie close to 0
    half = lambda x: x / 2
    magnitude = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))

    def part(scale: Callable[[Column], Column]) -> Column:
        low = scale(F.col("lo"))
        width = scale(F.col("hi")) - low
        even = F.least(F.floor((scale(v) - low) / width * parts), F.lit(parts - 1))
        return F.when((width > 0) & (width < float("inf")), even).when(v == F.col("lo"), 0).when(v == F.col("hi"), parts - 1).otherwise(1)

    done = [spans.filter(one).select(*keys, F.col("lo").alias("quantile"))]
    for scale in cycle((half, magnitude)):
        sorted_ = _within_spans(rows, spans.filter(small & ~one), named).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("v")))
        done.append(step.write(sorted_.filter("at = rank").select(*keys, F.col("v").alias("quantile")), "few"))
        spans = spans.filter(~small & ~one)
        if spans.isEmpty():
            break
        counts = _within_spans(rows, spans, named).groupBy(*keys, "rank", part(scale).alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("part"))  # at most ``parts`` rows
        held = counts.withColumn("upto", upto).filter("rank <= upto and rank > upto - m")
        spans = step.write(held.select(*keys, (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), "m", "lo", "hi"), "spans")
        done.append(spans.filter(one).select(*keys, F.col("lo").alias("quantile")))
        rows = step.write(_within_spans(rows, spans.filter(~one), named).select(*keys, "v"), "rows")
    out = materialize(reduce(DataFrame.unionByName, done).select(*[F.col(n).alias(g) for g, n in zip(groups, named, strict=True)], "share", "quantile"), "quantiles")
    step.clear()
    return out


def _within_spans(rows: DataFrame, spans: DataFrame, named: Sequence[str]) -> DataFrame:
    """The rows in each rank's range, with the range; rows that carry a rank already meet that alone. Ranges are broadcast while they are few."""
    own = [*named, *(["share"] if "share" in rows.columns else [])]
    right = spans.select(F.lit(0).alias("__all"), *[F.col(c).alias(f"__{c}") for c in own], *[c for c in ("share", "rank", "m", "lo", "hi") if c not in own])
    right = F.broadcast(right) if right.limit(SPANS + 1).count() <= SPANS else right
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own], F.lit(0) == F.col("__all"))
    return rows.join(right, same & F.col("v").between(F.col("lo"), F.col("hi"))).drop("__all", *[f"__{c}" for c in own])


def fences(df: DataFrame, value: str, groups: Sequence[str] = (), k: float = 1.5, accuracy: int | None = 10_000) -> DataFrame:
    """q1, q3, iqr, low and high (Tukey), in all or per group; quartiles are exact where no accuracy is given."""
    if accuracy is None:
        of = lambda share: F.max(F.when(F.col("share") == share, F.col("quantile")))
        q = exact_quantiles(df, value, [0.25, 0.75], groups).groupBy(*groups).agg(of(0.25).alias("q1"), of(0.75).alias("q3")).filter("q1 is not null")
    else:
        q = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(F.percentile_approx(value, [0.25, 0.75], accuracy).alias("q"))
        q = q.select(*groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.withColumn("low", F.col("q1") - k * F.col("iqr")).withColumn("high", F.col("q3") + k * F.col("iqr"))


def flag_outliers(df: DataFrame, value: str, groups: Sequence[str] = (), k: float = 1.5, accuracy: int | None = 10_000) -> DataFrame:
    """df with q1, q3, iqr, low, high and is_outlier; nothing is deleted. Overall fences are one row, which is broadcast."""
    f = fences(df, value, groups, k, accuracy)
    met = df.join(f, list(groups)) if groups else df.join(F.broadcast(f), F.lit(True))
    return met.withColumn("is_outlier", F.coalesce(S.outside(F.col(value), F.col("low"), F.col("high")), F.lit(False)))


def outlier_summary(flagged: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return flagged.groupBy(*groups, "q1", "q3", "iqr", "low", "high").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers")).withColumn(
        "share", S.share(F.col("outliers"), F.col("n"))
    )


def classify_outliers(flagged: DataFrame, ts: str, groups: Sequence[str], tie: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """An outlier with a neighbour in time that is one too is an ``event``, a lone one ``suspect``; others are ``normal``. Groups may be of any size."""
    met = with_neighbours(flagged, groups, [ts, *tie], {"__before": "is_outlier"}, {"__after": "is_outlier"}, rows)
    near = F.coalesce("__before", F.lit(False)) | F.coalesce("__after", F.lit(False))
    return met.withColumn("__near", near).drop("__before", "__after").withColumn("outlier_class", F.when(~F.col("is_outlier"), "normal").when(F.col("__near"), "event").otherwise("suspect")).drop("__near")


#: log2 of the registers of a sketch; the standard error of an estimate is 1.04 / sqrt(2 ** LG), 1.6 %, and counts below some hundreds are all but exact.
LG = 12


def distinct_sketches(df: DataFrame, ts: str, value: str, groups: Sequence[str] = (), lg: int = LG) -> DataFrame:
    """groups, date, sketch: which values a group had on each day, as a HyperLogLog sketch of fixed size. Rows without a time and null values are left out."""
    days = df.select(*groups, F.to_date(ts).alias("date"), F.col(value).alias("__v")).filter("date is not null and __v is not null")
    return days.groupBy(*groups, "date").agg(F.hll_sketch_agg("__v", lg).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One sketch per key for all given: those of late data and those stored, or those of the days of a span."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_between(sketches: DataFrame, first, last, groups: Sequence[str] = ()) -> DataFrame:
    """groups, n: about how many distinct values there were from day first to day last, from the stored sketches alone; any days may be asked for."""
    span = sketches.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return merged_sketches(span, groups).filter("sketch is not null").select(*groups, F.hll_sketch_estimate("sketch").alias("n"))


def distinct_bitmaps(df: DataFrame, ts: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, date, bucket, bitmap: which values (whole numbers) a group had on each day, exactly. A bitmap has a bit for each of the 32,768 values of
    its bucket, so it suits ids that lie close to each other; for others there are sketches. Rows without a time and null values are left out."""
    days = df.select(*groups, F.to_date(ts).alias("date"), F.col(value).cast("long").alias("__v")).filter("date is not null and __v is not null")
    return days.groupBy(*groups, "date", F.bitmap_bucket_number("__v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__v")).alias("bitmap"))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As ``merged_sketches``; the keys hold the bucket."""
    return bitmaps.groupBy(*keys).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def exact_between(bitmaps: DataFrame, first, last, groups: Sequence[str] = ()) -> DataFrame:
    """groups, n: how many distinct values there were from day first to day last, from the stored bitmaps alone; any days may be asked for."""
    span = bitmaps.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return merged_bitmaps(span, [*groups, "bucket"]).groupBy(*groups).agg(F.sum(F.bitmap_count("bitmap")).alias("n")).filter("n is not null")


def describe(df: DataFrame, filled: bool = False) -> DataFrame:
    """The schema as rows: position, name, type; if asked, with the number of values that aren't null, from one scan."""
    fields = list(df.schema)
    if not filled:
        return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "position int, name string, type string")
    one = lambda i, f: F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.col(f"`{f.name}`")).alias("filled"))
    return df.agg(F.array(*[one(i, f) for i, f in enumerate(fields)]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
