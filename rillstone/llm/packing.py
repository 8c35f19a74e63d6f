"""Best-fit packing of documents into sequences of a fixed capacity, by large-item matching.

Lengths are whole numbers up to the capacity, so a packing is decided for counts of lengths (a table of at most
``capacity`` rows, however many documents there are) and then read off by each piece:

1. Pieces above a third of the capacity are matched greedily: from the longest down, each takes the longest
   other that still fits, so a sequence holds at most two.
2. The others, from the longest down, go where they fit best: into the sequences with the least gap that
   holds them (as many as the gap holds), then into new ones.

A step of the plan says: the pieces of this length with ranks lo .. hi - 1 go to sequences from s on, so many in
each, at this offset. Ranks are counted within (length, salt) and offset by the counts of the salts before; a length has a
salt for every ``RANKED`` of its pieces, so one that a third of all pieces share is ranked in many tasks, and the table of
offsets has a row for so many pieces. Full pieces need no rank: each is a sequence, with a negative number.

Defined cases: a null text is empty, so its document is the end id alone; a document longer than the capacity is
cut, the remainder first; repeated rows are packed each; null ids are packed like others; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import bounded_batches, materialize
from rillstone.llm.tokens import encoder, vocabulary

CAPACITY = 1024
END = 2
RANKED = 1000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, lo, hi, sequence, each, offset) for counts of pieces by length.

    Works on at most ``capacity`` lengths and as many groups of like sequences, whatever the counts are.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    made = 0

    def put(size: int, n: int, first: int, each: int) -> None:
        nonlocal left
        steps.append((size, used[size], used[size] + n, first, each, 0))
        used[size] += n
        left[size] -= n

    def at(offset: int) -> None:
        steps[-1] = (*steps[-1][:5], offset)

    large = [s for s in sorted(left, reverse=True) if 3 * s > capacity]
    for size in large:
        while left[size]:
            other = next((b for b in large if b <= min(size, capacity - size) and left[b] and (b < size or left[b] > 1)), None)
            if other is None:
                n, gap = left[size], capacity - size
                put(size, n, made, 1)
            elif other == size:
                n, gap = left[size] // 2, capacity - 2 * size
                put(size, 2 * n, made, 2)
            else:
                n, gap = min(left[size], left[other]), capacity - size - other
                put(size, n, made, 1)
                put(other, n, made, 1)
                at(size)
            gaps.setdefault(gap, []).append((made, n))
            made += n
    for size in (s for s in sorted(left, reverse=True) if 3 * s <= capacity):
        while left[size]:
            gap = min((g for g, runs in gaps.items() if g >= size and runs), default=capacity)
            if gap == capacity:
                each = capacity // size
                n = -(-left[size] // each)
                first, number = made, n
                made += n
            else:
                first, number = gaps[gap].pop()
                each = gap // size
                n = min(number, -(-left[size] // each))
                if n < number:
                    gaps[gap].append((first + n, number - n))
            items = min(left[size], n * each)
            put(size, items, first, each)
            at(capacity - gap)
            rest = items - (n - 1) * each  # in the last sequence
            if rest == each:
                gaps.setdefault(gap - each * size, []).append((first, n))
            else:
                if n > 1:
                    gaps.setdefault(gap - each * size, []).append((first, n - 1))
                gaps.setdefault(gap - rest * size, []).append((first + n - 1, 1))
    return steps


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY, tokens: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces; with tokens also their ids."""
    bounded_batches(docs.sparkSession)
    tokenizer = tokenizer or vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if tokens else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.array([end], np.uint32)
        for b in batches:
            rows: list[tuple] = []
            bodies: list[np.ndarray] = []
            for i, got in zip(b.column(0).to_pylist(), encode.each(b.column(1).to_pylist()), strict=True):
                ids = np.concatenate([got, tail]).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, k, lo, hi - lo, zlib.crc32(ids[lo:hi])))
                    bodies += [ids[lo:hi]] if tokens else []
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            if tokens:
                columns.append(pa.array([x.astype(np.int32) for x in bodies], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity=capacity, **options), "pieces")
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = cut.filter(F.col("length") < capacity)
    by_length = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}  # less than capacity rows
    steps = spark.createDataFrame(plan(by_length, capacity) or [(0, 0, 0, 0, 1, 0)], "size long, lo long, hi long, first long, each long, at long")
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in by_length.items()] or [(0, 1)], "length long, salts long")
    salted = part.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("r", F.row_number().over(within) - 1)
        .join(bases.select("length", "salt", "base"), ["length", "salt"])
        .withColumn("r", F.col("r") + F.col("base"))
    )
    # the steps number in proportion to the capacity, not to the documents
    placed = ranked.join(F.broadcast(steps), (F.col("length") == F.col("size")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    turn = F.col("r") - F.col("lo")
    placed = placed.select(
        *cut.columns,
        (F.col("first") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + turn % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
    return placed.unionByName(full)
