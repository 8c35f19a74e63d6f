"""Mixing sources to target weights: repetition rates per source, then copies per document.

Tokens are counted per source (a partial aggregation: a hot source is summed where its rows lie).
Targets share ``budget`` of all tokens by the sources' weights, and no source gets more than ``most``
times its own tokens: what a capped source leaves is shared among the others by weight. A source's rate
is target / tokens; a document is taken floor(rate) times, and once more with probability rate - floor,
decided by a hash of the seed and its id, so reruns agree and no row has to meet another.

Defined cases: a null or empty text has size 0; a null source is a source of its own, last in order; a
source without tokens has target 0 and rate 0; rows that repeat an id are decided alike; a null id is
decided by the text; an empty table gives an empty table; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import WORDS, Scratch, join_split, materialize

#: A rates table up to so many rows is broadcast; of a larger one the hot sources are, the others are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _ranked(sources: DataFrame, tables: Scratch) -> DataFrame:
    """sources with rank, from 0 by code point, null last: ranges of sources are ranked by themselves, and the sizes of the
    ranges before are added. No task gets more than a range."""
    order = F.col("source").asc_nulls_last()
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tables.write(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy(order)
    return dealt.join(F.broadcast(bases.select("part", "base")), "part").withColumn("rank", F.col("base") + F.row_number().over(within) - 1).drop("part", "base")  # a row a range


def source_rates(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, rows, source_size, target, rate, from rows of (source, size); written.

    Water filling: shares by weight; sources whose share is above their cap get the cap, and what they leave is shared again
    among the others until none is above. A round is one aggregation over the sources; its two sums alone reach the driver.
    """
    tables = Scratch(sizes.sparkSession)
    sums = tables.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = _ranked(sums, tables).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = tables.write(t, "weighed")
    total, rest_weight = t.agg(F.sum("source_size"), F.sum("weight")).first()
    all_, rest = (total or 0) * float(budget), (total or 0) * float(budget)
    while rest_weight:
        over = F.lit(rest) * F.col("weight") > F.col("cap") * F.lit(rest_weight)
        capped, left = t.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if left == rest_weight:
            break
        rest, rest_weight = all_ - capped, left
    target = F.col("cap")
    if rest_weight:
        target = F.when(F.lit(rest) * F.col("weight") > F.col("cap") * F.lit(rest_weight), F.col("cap")).otherwise(F.lit(rest / rest_weight) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = materialize(t.withColumn("target", target).select("source", "rows", "source_size", "target", rate.alias("rate")), "rates")
    tables.clear()
    return rates


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies; with carry also row, a
    struct of all its columns."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    plain = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size_of(F.col(text_col)).alias("size"),
        uniform(seed, key).alias("u"),
        *([F.struct(F.col("*")).alias("row")] if carry else []),
    )
    if not carry:
        plain = materialize(plain, "sizes")
    rates = source_rates(plain.select("source", "size"), weights, budget, most)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias("name")
    rates = rates.select(name("source"), "rows", "source_size", "target", "rate")
    plain = plain.withColumn("name", name("source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        met = plain.join(F.broadcast(rates), "name")
    else:
        met = join_split(plain, rates, "name")
    whole = F.floor("rate")
    return met.withColumn("copies", whole + F.when(F.col("u") < F.col("rate") - whole, 1).otherwise(0)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", *(["row"] if carry else [])
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as its copies, with all its columns."""
    plan = mix_plan(docs, carry=True, **options).filter("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
