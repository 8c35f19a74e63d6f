"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A block holds ``BLOCK`` ids. Its least id is subtracted; the rest is packed, bit plane by bit plane, at the width of the
percentile among ``PERCENTILES`` that makes the block smallest, and larger values go to an exception list (place, value).
A payload is

    header   6 x uint32  magic, ids, blocks, ids a block, bytes of the packed part, exceptions
    index    blocks x (uint32 start of the block in the packed part, uint32 first exception)
    bases    blocks x uint32
    widths   blocks x uint8
    packed   blocks, each ``BLOCK * width / 8`` bytes
    places   exceptions x uint8, values exceptions x uint32

Documents are dealt by ranges of (doc_id, hash of the text), sorted within each range, encoded and written
as one row a segment: whole documents of at least ``SEGMENT`` ids together, with their ids and lengths. A range is a
shard; shards are in ascending order. Only counts per shard are summed globally.

Defined cases: a null text is empty, so its document has the end id alone; null ids come first; rows that repeat
an id lie side by side in the order of their texts' hashes; an empty table gives no segment; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import bounded_batches, new_path
from rillstone.llm.tokens import encoder, vocabulary

MAGIC = 0x31524F46
BLOCK = 256
PERCENTILES = (0.75, 0.9, 0.98, 1.0)
_EXCEPTION = 40  # bits of an exception
SEGMENT = 1 << 16
END = 0
_SCHEMA = "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK, percentiles: tuple[float, ...] = PERCENTILES) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    if block % 8 or not 0 < block <= 256:
        raise ValueError("a block has a multiple of 8 ids, 256 at most")
    n = len(ids)
    blocks = -(-n // block)
    if not blocks:
        return np.array([MAGIC, 0, 0, block, 0, 0], "<u4").tobytes()
    grid = np.full(blocks * block, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, block)
    bases = grid.min(axis=1)
    rest = grid - bases[:, None]
    kth = np.array(sorted({max(0, int(np.ceil(block * p)) - 1) for p in percentiles}))
    tops = np.partition(rest, kth, axis=1)[:, kth]
    bits = np.zeros(tops.shape, np.int64)
    for k in range(32):
        bits += tops >= np.uint32(1 << k)
    choice = np.argmin(bits * block + (block - 1 - kth) * _EXCEPTION, axis=1)
    widths = bits[np.arange(blocks), choice].astype(np.uint8)
    starts = np.concatenate(([0], np.cumsum(widths.astype(np.int64) * (block // 8))))
    packed = np.zeros(int(starts[-1]), np.uint8)
    tops = ((1 << widths.astype(np.uint64)) - 1).astype(np.uint32)  # the largest value of each width
    rows, places = np.nonzero(rest > tops[:, None])
    for w in np.unique(widths):
        if not w:
            continue
        own = np.nonzero(widths == w)[0]
        values, plane = rest[own], block // 8
        at_byte = starts[own][:, None] + np.arange(plane)
        for k in range(int(w)):
            packed[at_byte + k * plane] = np.packbits((values & np.uint32(1 << k)) != 0, axis=1)
    first = np.searchsorted(rows, np.arange(blocks))
    index = np.stack([starts[:-1], first], axis=1).astype("<u4")
    head = np.array([MAGIC, n, blocks, block, len(packed), len(rows)], "<u4")
    return b"".join(
        [head.tobytes(), index.tobytes(), bases.astype("<u4").tobytes(), widths.tobytes(), packed.tobytes(), places.astype(np.uint8).tobytes(), rest[rows, places].astype("<u4").tobytes()]
    )


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first .. last - 1 (all by default), read through the index."""
    magic, n, blocks, block, size, exceptions = (int(x) for x in np.frombuffer(payload, "<u4", 6))
    if magic != MAGIC:
        raise ValueError("not a block file")
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, np.uint32)
    at = 24
    index = np.frombuffer(payload, "<u4", 2 * blocks, at).reshape(blocks, 2).astype(np.int64)
    at += 8 * blocks
    bases = np.frombuffer(payload, "<u4", blocks, at)
    at += 4 * blocks
    widths = np.frombuffer(payload, np.uint8, blocks, at)
    at += blocks
    packed = np.frombuffer(payload, np.uint8, size, at)
    at += size
    places = np.frombuffer(payload, np.uint8, exceptions, at)
    values = np.frombuffer(payload, "<u4", exceptions, at + exceptions)
    out = np.zeros((last - first, block), np.uint32)
    for w in np.unique(widths[first:last]):
        if not w:
            continue
        own = first + np.nonzero(widths[first:last] == w)[0]
        plane = block // 8
        at_byte = index[own, 0][:, None] + np.arange(plane)
        got = np.zeros((len(own), block), np.uint32)
        for k in range(int(w)):
            got |= np.unpackbits(packed[at_byte + k * plane], axis=1).astype(np.uint32) << np.uint32(k)
        out[own - first] = got
    bounds = np.append(index[:, 1], exceptions)
    lo, hi = int(bounds[first]), int(bounds[last])
    rows = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
    out[rows - first, places[lo:hi]] = values[lo:hi]
    out += bases[first:last, None]
    return out.ravel()[: min(n, last * block) - first * block]


def write_tokens(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end: int = END,
    block: int = BLOCK,
    percentiles: tuple[float, ...] = PERCENTILES,
    segment: int = SEGMENT,
) -> str:
    """Writes the ids of all documents in ascending order of id; returns the folder. ``tokenizer`` is the path of
    the vocabulary on the executors."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or new_path(spark, "tokens")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )
    tokenizer = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.array([end], np.uint32)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        lengths: list[int] = []
        number, first, size, shard = 0, 0, 0, 0

        def row() -> pa.RecordBatch:
            payload = pack(np.concatenate(held), block, percentiles)
            columns = [[shard], [number], [first], [size], [list(ids)], [list(lengths)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "first_id", "n_ids", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for i, got, s in zip(b.column(0).to_pylist(), encode.each(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                shard = s
                held += [got, tail]
                ids.append(i)
                lengths.append(len(got) + 1)
                size += len(got) + 1
                if size >= segment:
                    yield row()
                    number, first, size = number + 1, first + size, 0
                    held, ids, lengths = [], [], []
        if ids:
            yield row()

    dealt.mapInArrow(run, _SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    bounded_batches(spark)
    files = spark.read.schema(_SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(  # a row a partition of the writer
        F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, first, ids, lengths, payload = (b.column(c)[k].as_py() for c in range(5))
                values = unpack(payload).astype("<u4")
                stops = np.cumsum(lengths)
                starts = stops - lengths
                crc = [zlib.crc32(values[a:z]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts + first), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.select("shard", "first_id", "doc_ids", "lengths", "payload").mapInArrow(
        run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(shards, rows.shard == shards.of).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
