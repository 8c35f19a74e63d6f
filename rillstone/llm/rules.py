"""Quality rules: plain counts per text, then a log-likelihood ratio between a trusted target and the raw corpus.

n-grams of ``N`` bytes of a text are hashed into ``2 ** BITS`` buckets. Bucket counts of the raw corpus are taken over
every document, those of the target over every trusted one (label 1); their ids are broadcast only up to a counted
number, else joined by a shuffle. A document's score is the mean over its n-grams of
log p(target) - log p(raw), both multinomials smoothed by one; it is kept if no plain rule fails and the score is
at least ``THRESHOLD``, the same number for every document and corpus.

Defined cases: a null or empty text has no words, so it fails the plain rule and is not kept; a text shorter than an
n-gram has score 0; repeated rows are told alike; without trusted documents every score is 0 and the plain rules
decide; null ids are carried through and never trusted; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.store import Scratch, bounded_batches, small

N = 3
BITS = 14
THRESHOLD = -0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PART = 1 << 20


def hashed(text: str | None, n: int = N, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in order, by parts of bounded length."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for lo in range(0, len(b) - n + 1, _PART):
        part = b[lo : lo + _PART + n - 1].astype(np.uint32)
        size = len(part) - n + 1
        x = part[:size].copy()
        for k in range(1, n):
            x |= part[k : k + size] << np.uint32(8 * k)
        yield (x * np.uint32(2654435761)) >> np.uint32(32 - bits)


def plain(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = _WORD.findall(text)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and not x.isspace() or _WORD.search(x)]
    repeats = 0
    if len(words) > 3:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, which, times = np.unique(pair[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = np.nonzero(times[which] > 1)[0]
        marked = np.zeros(len(words), bool)
        for k in range(3):
            marked[twice + k] = True
        repeats = int(marked.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, bits: int = BITS) -> np.ndarray:
    """log p(target) - log p(raw) of every bucket, from counts over all documents and all trusted ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    step = Scratch(spark)
    good = step.write(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for x in hashed(t, n, bits):
                    counts += np.bincount(x, minlength=size)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    counts = np.zeros((2, size))
    for k, part in enumerate((texts, texts.join(small(good), "doc_id", "left_semi"))):
        for r in part.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 ** bits rows
            counts[k, r["bucket"]] = r["n"]
    step.clear()
    if not counts[1].sum():
        return np.zeros(size, np.float64)
    log = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + size))
    return log[1] - log[0]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    ratio = ratios(docs, labels, id_col, text_col, **options)
    n, bits = options.get("n", N), options.get("bits", BITS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                total, grams = 0.0, 0
                for x in hashed(t, n, bits):
                    total += float(ratio[x].sum())
                    grams += len(x)
                rows.append((*plain(t), total / grams if grams else 0.0))
            columns = [pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int64() if k < 5 else pa.float64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return told.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
