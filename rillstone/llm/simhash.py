"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: the text with A-Z in lower case, its words, shingles of ``WIDTH`` words (all words if there
are fewer), XXH64 with seed 42 of each; a bit is 1 if more than half the hashes set it.

Candidates: bit i of the fingerprint gets the nonzero vector phi(i) of r + 1 bits, and table v (any nonzero
vector) keeps the bits with <phi(i), v> = 1. Any two fingerprints that differ in at most r bits agree in all
kept bits of some table, since at most r vectors always have a nonzero v orthogonal to them. So no pair within
the radius is missed; a table keeps about 4/7 of the 64 bits for r = 2.

Work goes by distinct fingerprint: copies are one class whatever their number. A bucket of at most ``SMALL``
fingerprints is compared in place. Those of a larger one agree in the kept bits and may differ in the free ones, so
the same masks are laid over the free bits: a pair within the radius meets again in a smaller bucket. A bucket is not
split further when so few bits are free that at most 64 values fit in it; for r = 2 that is so after three rounds.
Only true links are given; nothing is capped.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and is linked like any
other; null ids keep their row and never become a component's id unless it has no other (then null); an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.components import components
from rillstone.llm.store import Scratch, bounded_batches, join_split, materialize, small

WIDTH = 3
RADIUS = 2
SMALL = 8
_STEP = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = max(len(words) - width + 1, 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:last].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, last, _STEP):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[lo : lo + _STEP], stops[lo : lo + _STEP])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fp, the fingerprint as a signed long, of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return picked.mapInArrow(run, "doc_id long, text_hash long, fp long")


def covering_masks(radius: int = RADIUS, free: int = (1 << 64) - 1) -> list[int]:
    """The 2^(radius+1) - 1 masks over the free bits, as unsigned longs."""
    top = 1 << (radius + 1)
    places = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for k, i in enumerate(places) if ((k % (top - 1) + 1) & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, radius: int = RADIUS, most: int = SMALL, into: Scratch | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints: all pairs within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("a radius of 0 to 3 bits")
    spark = classes.sparkSession
    into = into or Scratch(spark)
    last = max(6, (1 << radius) - 1)  # with so many free bits a bucket is compared whatever it holds; with more, every mask keeps some
    near = f"transform(filter(f, y -> y > x and bit_count(x ^ y) <= {radius}), y -> struct(x as a, y as b))"
    rows, kept, found = classes, {0}, []
    while kept:
        masks = sorted({(k, k | m) for k in kept for m in covering_masks(radius, ~k & (1 << 64) - 1)})
        split = {new for _, new in masks if (~new & (1 << 64) - 1).bit_count() > last}
        if kept == {0}:
            each = F.array(*[F.struct(F.lit(_signed(new)).alias("kept"), F.lit(new in split).alias("more")) for _, new in masks])
            rows = rows.select("fp", F.explode(each).alias("t")).select("fp", "t.*")
        else:
            table = spark.createDataFrame([(_signed(k), _signed(new), new in split) for k, new in masks], "kept long, next long, more boolean")
            rows = rows.join(F.broadcast(table), "kept").select("fp", F.col("next").alias("kept"), "more").distinct()  # a few hundred masks at most
        rows = into.write(rows.withColumn("key", F.xxhash64("kept", F.col("fp").bitwiseAND(F.col("kept")))), "buckets")
        full = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n"))
        met = into.write(join_split(rows, into.write(full, "sizes"), "key"), "met")
        split_on = F.col("more") & (F.col("n") > most)
        few = met.filter(~split_on).groupBy("key").agg(F.collect_list("fp").alias("f"))
        found.append(few.select(F.explode(F.expr(f"flatten(transform(f, x -> {near}))")).alias("l")).select("l.*"))
        rows = met.filter(split_on).select("fp", "kept")
        kept = split if not rows.isEmpty() else set()
    return functools.reduce(DataFrame.unionByName, found).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, component_id (the smallest doc_id reachable, itself included)."""
    step = Scratch(docs.sparkSession)
    prints = step.write(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = step.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "classes")
    reach = components(links(classes, radius, into=step), step)
    named = classes.join(reach, classes.fp == reach.node, "left").select("fp", "rows", "least", F.coalesce("component", "fp").alias("component"))
    named = step.write(named, "named")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = step.write(named.join(heads, "component").select("fp", "rows", "component_id"), "of")
    told = materialize(join_split(prints, of, "fp").select("doc_id", "text_hash", "fp", "component_id"), "groups")
    step.clear()
    return told


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of a component other than its smallest id, with all columns. Rows without an id
    stay, and rows that repeat the id that stays (exact dedup is a step of its own)."""
    return without(docs, near_groups(docs, id_col, text_col), id_col, text_col)


def without(docs: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose doc_id and text_hash have another component_id in told."""
    gone = told.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = small(materialize(gone.distinct(), "near"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(F.col("*")).alias("r"), F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("h"))
    return whole.join(gone, (F.col("i") == F.col("gone_id")) & (F.col("h") == F.col("gone_hash")), "left_anti").select("r.*")
