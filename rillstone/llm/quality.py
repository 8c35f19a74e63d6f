"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Fitting uses a bounded sample of labelled rows: of those that may be learnt from, the ``per_class`` of each label with
the least hash of their id. On it
1. the ``vocabulary`` most frequent terms are counted (runs of letters, of digits, single signs);
2. every term gets a sparse index vector of ``ones`` entries of +1 or -1, from a seeded generator, and a term's word vector
   is the sum of the index vectors within ``WINDOW`` places of it, over the sample, damped by log and normed; terms beyond
   the vocabulary share the vector of their shape (all capitals, capitalised, lower case, digits, sign);
3. a document is the mean of its terms' vectors, beside the mean of the products of neighbouring terms' order vectors: dense
   random index vectors of +1 and -1 (terms beyond the vocabulary share ``HASHED`` of them by their hash), so that repeated
   terms pull every entry up and text that never repeats stays near zero; nothing but pooled vectors is seen;
4. a network with one hidden layer is trained with numpy; on a fifth of the sample a temperature is chosen by likelihood,
   and the classes' shares in all learnable labels correct for the balanced sample.

Scores are computed for whole texts, in tasks, from the text alone.

Defined cases: a null text is empty; an empty text has the zero vector and gets a score like any other; if the learnable
labels lack a class, every score is the share of label 1 (0.5 without any label); repeated rows score alike; labels that
repeat an id count once, as the larger; null ids are scored and told as held out; an empty table gives an empty table; extra columns are carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.store import Scratch, bounded_batches

TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
SHAPES = ("<AA>", "<Aa>", "<aa>", "<0>", "<.>")
WINDOW = 2
HASHED = 4096
CUT = 0.7


def _shape(term: str) -> int:
    if term.isupper():
        return 0
    if term[0].isalpha():
        return 1 if term[0].isupper() else 2
    return 3 if term.isdigit() else 4


@dataclass
class Model:
    index: dict[str, int] = field(default_factory=dict)  # term -> row of vectors; shapes are the last rows
    vectors: np.ndarray | None = None
    orders: np.ndarray | None = None  # order vectors of the vocabulary, then of hashed terms
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    shift: float = 0.0
    share: float = 0.5

    def rows(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of vectors and of orders."""
        get, last = self.index.get, len(self.index)
        rows = np.array([get(t, -1) for t in terms], np.int64)
        hashed = rows.copy()
        for k in np.flatnonzero(rows < 0).tolist():
            t = terms[k]
            rows[k] = last + _shape(t)
            hashed[k] = last + zlib.crc32(t.encode("utf-8", "surrogatepass")) % HASHED
        return rows, hashed

    def features(self, text: str | None) -> np.ndarray:
        pooled, order, n = np.zeros(self.vectors.shape[1]), np.zeros(self.orders.shape[1]), 0
        before = np.zeros(0, np.int64)
        for held in _parts(text or ""):
            rows, hashed = self.rows(held)
            pooled += self.vectors[rows].sum(axis=0)
            run = self.orders[np.concatenate([before, hashed])]
            order += (run[1:] * run[:-1]).sum(axis=0, dtype=np.int64)
            n += len(held)
            before = hashed[-1:]
        return np.concatenate([pooled / max(n, 1), order / max(n - 1, 1)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return (np.tanh(z @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        z = self.logits(np.stack([self.features(t) for t in texts])) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(text: str, size: int = 1 << 16) -> Iterator[list[str]]:
    """All terms, in lists of bounded length."""
    if len(text) <= 4 * size:
        if found := TERM.findall(text):
            yield found
        return
    held: list[str] = []
    for m in TERM.finditer(text):
        held.append(m[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def learnable(id_col: str = "doc_id") -> Column:
    """Whether a row may be learnt from: the CRC-32 of its id as text, modulo 4, isn't 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _train(x: np.ndarray, y: np.ndarray, w: np.ndarray, hidden: int, seed: int, epochs: int = 300, rate: float = 0.01, decay: float = 1e-4) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 512):
            k = order[lo : lo + 512]
            h = np.tanh(x[k] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip((h @ p[2] + p[3])[:, 0], -30, 30)))
            d = ((out - y[k]) * w[k] / w[k].sum())[:, None]
            dh = d @ p[2].T * (1 - h * h)
            grads = [x[k].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], d.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    per_class: int = 3000, vocabulary: int = 5000, dim: int = 48, ones: int = 4, order: int = 16, hidden: int = 16, seed: int = 7,
) -> Model:
    """A model from at most ``2 * per_class`` labelled documents for which ``learnable`` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = labels.filter(learnable("doc_id") & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    step = Scratch(spark)
    usable = step.write(usable, "usable")
    totals = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    every = sum(totals.values())
    if len(totals) < 2:
        return Model(share=totals.get(1, 0) / every if every else 0.5)
    picked = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = step.write(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("label_id"), "quality"), "picked")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sample = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # at most 2 * per_class ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    )
    sample = step.write(sample.repartition(8, "doc_id"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for terms in _parts(t):
                    counts.update(terms)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    top = sample.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(vocabulary)
    model = Model(index={r["term"]: i for i, r in enumerate(top.collect())})
    rows = len(model.index) + len(SHAPES)
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((rows, dim)), axis=1)[:, :ones]
    signs = rng.choice([-1, 1], (rows, ones))
    model.orders = rng.choice(np.array([-1, 1], np.int8), (len(model.index) + HASHED, order))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(rows * dim, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for terms in _parts(t):
                    ids = model.rows(terms)[0]
                    for k in range(1, WINDOW + 1):
                        for here, there in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
                            for j in range(ones):
                                np.add.at(sums, here * dim + places[there, j], signs[there, j])
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype("<i8").tobytes()], pa.binary())], names=["sums"])

    sums = np.zeros((rows, dim))
    for r in sample.select("text").mapInArrow(neighbours, "sums binary").collect():  # one row of fixed size a task, 8 tasks
        sums += np.frombuffer(r["sums"], "<i8").reshape(rows, dim)
    damped = np.sign(sums) * np.log1p(np.abs(sums))
    model.vectors = (damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["h", "x", "quality"])

    key = F.xxhash64("doc_id").alias("h")
    got = sorted(sample.select(key, "text", "quality").mapInArrow(features, "h long, x array<double>, quality int").collect())
    step.clear()
    x, y = np.array([r[1] for r in got]), np.array([float(r[2]) for r in got])
    if len(set(y)) < 2:
        return Model(share=totals.get(1, 0) / every)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    balance = np.where(y == 1, 0.5 / max(y[~held].mean(), 1e-9), 0.5 / max(1 - y[~held].mean(), 1e-9))
    model.weights = _train(z[~held], y[~held], balance[~held], hidden, seed)
    model.share = totals[1] / every
    model.shift = float(np.log(totals[1] / totals[0]))
    check = held if held.any() else ~held
    raw = model.logits(x[check])
    weight = np.where(y[check] == 1, model.share / max(y[check].sum(), 1), (1 - model.share) / max((1 - y[check]).sum(), 1))
    sign = np.where(y[check] == 1, 1, -1)
    loss = lambda t: float((weight * np.logaddexp(0, -sign * (raw / t + model.shift))).sum())
    model.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row, a struct of all columns of docs, and the score of each whole text, from 0 to 1; so no column of docs is in the way."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.select(F.struct(F.col("*")).alias("row"), score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("score"))


def keep(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the cut."""
    return scored(docs, model, text_col).filter(F.col("score") >= cut).select("row.*")
