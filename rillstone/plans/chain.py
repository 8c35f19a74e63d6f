"""The whole chain over a feed of readings: layers -> bronze -> silver -> dimensions -> fact.

Readings are merged by their key, so running the chain again with the same or overlapping files changes nothing. Those without
an id are put aside in bronze, those that fail a check in silver. The fact is recomputed for the (station, day) pairs that a feed
touches, from all their readings in silver, and replaced where it differs: a reading that comes late corrects its day, whatever
was loaded before, and no other row is touched. A run reads of its tables only what its feed reaches: bronze by ranges of ids,
silver by ranges of days, the fact by its days. It works from the tables, not from what a step has just added, so a
run that broke off is made up for by running it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import scalars as S
from rillstone.operators import dedupe, series, shape, star
from rillstone.shared import Scratch
from rillstone.sources import sinks

#: Which sensor stands for which measure.
MEASURES = {"level": "view", "flow": "signup", "rain": "purchase", "temp": "click"}


def run(
    spark: SparkSession, feed: DataFrame, prefix: str = "", highest: float = 300.0, level_scale: float = 0.01, measures: dict[str, str] = MEASURES, locations: DataFrame | None = None,
    attributes: Sequence[str] = (), updated: str | None = None,
) -> dict[str, str]:
    """feed: event_id, station, sensor, ts (ISO text), value. Returns the databases by layer.

    ``locations`` describes stations (station, the attributes named and the time of each version): the newest version is kept whole."""
    layers = dict(zip(sinks.LAYERS, sinks.create_layers(spark, prefix), strict=True))
    bronze, silver, gold = layers["bronze"], layers["silver"], layers["gold"]

    step = Scratch(spark)
    feed = step.write(feed.select("event_id", "station", "sensor", "ts", "value"), "feed")
    sinks.merge_insert(feed, f"{bronze}.reading", ["event_id"], prune="event_id", aside=f"{bronze}.quarantine")

    landed = sinks.within(spark.table(f"{bronze}.reading"), feed, "event_id").join(feed.select("event_id").distinct(), "event_id", "left_semi")
    typed = step.write(landed.withColumn("ts", S.to_ts(F.col("ts"))), "typed")
    checks = {"no_station": F.col("station").isNotNull(), "no_sensor": F.col("sensor").isNotNull(), "bad_ts": F.col("ts").isNotNull(), "bad_value": F.col("value").isNotNull(), "out_of_bounds": F.col("value") <= highest}
    valid, aside = shape.split_valid(typed, checks)
    sinks.merge_insert(dedupe.first_by(valid, ["station", "sensor", "ts"], [F.desc("event_id")]), f"{silver}.reading", ["station", "sensor", "ts"], prune="ts")
    sinks.merge_insert(aside, f"{silver}.quarantine", ["event_id"], prune="event_id")

    touched = step.write(valid.select("station", F.to_date("ts").alias("date")).distinct(), "touched")
    daily = step.write(touched_daily(spark.table(f"{silver}.reading"), touched), "daily")
    _locate(spark, f"{gold}.dim_location", touched, locations, attributes, updated)
    sinks.merge_insert(star.dimension(daily, ["sensor"], key="source_key"), f"{gold}.dim_source", ["source_key"])
    dates = touched.select("date")
    if spark.catalog.tableExists(f"{gold}.dim_time"):  # the calendar has no gaps between feeds
        dates = dates.unionByName(spark.table(f"{gold}.dim_time").agg(F.array(F.min("date"), F.max("date")).alias("d")).select(F.explode("d").alias("date")))
    sinks.merge_insert(star.dim_time(dates), f"{gold}.dim_time", ["time_key"])

    def of(name: str, column: str, scale: float = 1.0) -> DataFrame:
        return daily.filter(F.col("sensor") == measures[name]).select("station", "date", (F.col(column) * scale).alias(name))

    fact = star.fact_daily(of("level", "mean", level_scale), [of("flow", "mean"), of("rain", "sum"), of("temp", "mean")], ["station", "date"])
    keyed = star.with_keys(fact, [(spark.table(f"{gold}.dim_location"), ["station"], "location_key"), (spark.table(f"{gold}.dim_time").select("date", "time_key"), ["date"], "time_key")])
    sinks.upsert(keyed.select("location_key", "level", "flow", "rain", "temp", "time_key"), f"{gold}.fact_daily_level", ["location_key", "time_key"], "time_key")
    step.clear()
    return layers


def touched_daily(reading: DataFrame, touched: DataFrame) -> DataFrame:
    """The daily series of the touched (station, date) pairs, from all their readings: of the table only the ranges of days are read."""
    found = sinks.ranges(touched, "date")
    if not found:
        reading = reading.limit(0)
    else:
        day = lambda x: F.lit(x).cast("timestamp")
        reading = reading.filter(reduce(lambda x, y: x | y, [(F.col("ts") >= day(a)) & (F.col("ts") < day(b) + F.expr("interval 1 day")) for a, b in found]))
    of = reading.withColumn("date", F.to_date("ts")).join(touched, ["station", "date"], "left_semi")
    return series.daily(of, "ts", "value", ["station", "sensor"])


def _locate(spark: SparkSession, name: str, touched: DataFrame, locations: DataFrame | None, attributes: Sequence[str], updated: str | None) -> None:
    """Keeps the newest version of each station described; stations that nothing describes get a row without attributes."""
    keyed = lambda df, *a: star.dimension(df, ["station"], *a).withColumn("bucket", sinks.partition_of("location_key"))
    if locations is not None:
        sinks.upsert(keyed(locations, attributes, "location_key", updated), name, ["location_key", "station"], "bucket", updated)
    plain = keyed(touched, (), "location_key")
    if spark.catalog.tableExists(name):
        there = spark.table(name)
        plain = plain.join(there.select("location_key"), "location_key", "left_anti").select(*[F.col(f.name) if f.name in plain.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema])
    sinks.upsert(plain, name, ["location_key", "station"], "bucket")
