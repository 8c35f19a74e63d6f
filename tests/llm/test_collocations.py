"""Collocations against brute force; summaries against their promise; exact scores."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import edge, empty, real
from pyspark.sql import functions as F

from rillstone.llm import collocations as C
from rillstone.llm.store import Scratch


def brute_counts(rows, longest=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    return f, n


def brute(rows, longest=3, often=10, share=50, top=2000):
    f, n = brute_counts(rows, longest)
    found = {p: a for p, a in f.items() if a >= often and len(p[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        if any(100 * b >= share * a for (k, v), b in found.items() if k == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    told, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            told.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(told)


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(n=300):
    rng = random.Random(2)
    words = ["red", "blue", "the", "x y", "É", "\x0b", "a\x1cb", "Fox", "fox", "of", "über", ".", "!", "\t", "\n"]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice(["", " new york city", "  New  York", "ice cream. Ice cream"])
    return [(rng.choice(["en", "en", None, "und", "de"]), said()) for _ in range(n)] + [("en", "same line " * 50)] * 20


def test_real_documents(spark):
    docs = real(spark)
    assert told(C.collocations(docs)) == brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()])


@pytest.mark.parametrize("flush, part, slice_, longest, top", [(2_000_000, 64 << 20, 1 << 20, 3, 2000), (300, 500, 7, 4, 15)])
def test_made_documents(spark, monkeypatch, flush, part, slice_, longest, top):
    """Also with small flushes, many hash partitions, short slices, longer phrases and hot first words joined map-side."""
    for name, value in (("WORDS_A_FLUSH", flush), ("PART_BYTES", part), ("SLICE", slice_)):
        monkeypatch.setattr(C, name, value)
    rows = made()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, longest=longest, top=top)
    assert len(want) > 20
    assert told(C.collocations(df, longest=longest, top=top)) == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BYTES", 64)
    rows = made(100)
    assert told(C.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)


@pytest.mark.parametrize("capacity", [3, 20, 100])
def test_summaries_keep_what_is_frequent(capacity):
    """With a capacity above mass / threshold, and where it is too small, as then the summary grows."""
    rng = np.random.default_rng(7)
    keys = np.minimum(rng.zipf(1.5, 900), 400).astype(np.uint64)
    exact = Counter(keys.tolist())
    s = C.Summary(capacity, 10)
    for part in np.array_split(keys, 40):
        h, n = np.unique(part, return_counts=True)
        s.add(h, n)
        s.merge()
        assert s.lost < 10 and (s.lost > 0 or len(s.hashes) <= len(exact))
    left = set(s.survivors().tolist())
    assert {k for k, n in exact.items() if n >= 10} <= left
    assert all(exact[k] >= n for k, n in zip(s.hashes.tolist(), s.counts.tolist()))
    if capacity > 90:
        assert len(s.hashes) <= capacity


def test_phrases_of_a_run():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, 500)
    a = a[a != 1]
    for k in (1, 2, 3, 4):
        want = Counter(tuple(a[i : i + k].tolist()) for i in range(len(a) - k + 1) if (a[i : i + k] > 1).all())
        for n_ids in (9, 1 << 22, 1 << 31):  # numbers that need no, one or two steps
            columns, counts = C._counted(a, k, n_ids)
            assert dict(zip(zip(*[c.tolist() for c in columns]), counts.tolist())) == want


def test_hashes_packed():
    h = np.array([0, 1, (1 << 48) - 1, 123456789012345], np.uint64)
    assert (C._unpacked(C._packed(h).tobytes()) == h).all()


def test_scores_are_exact(spark):
    rows = [(10**15, 10**15 + 7, 10**15 + 1), (3 * 10**9, 7 * 10**12 + 1, 9 * 10**9 - 1), (10, 10, 10), (10, 1999, 5003)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_edges(spark):
    rows = [(r.lang, r.text) for r in edge(spark).collect()]
    assert told(C.collocations(edge(spark))) == brute(rows)
    assert C.collocations(empty(spark)).count() == 0
    counts = {(r.lang, r.k, r.phrase): r.n for r in C.phrase_counts(edge(spark), often=1, into=Scratch(spark)).collect()}
    f, n = brute_counts(rows)
    assert counts == {(lang, len(w), " ".join(w)): c for (lang, w), c in f.items()} | {(lang, 0, ""): c for lang, c in n.items()}
