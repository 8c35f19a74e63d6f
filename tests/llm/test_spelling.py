"""Spelling variants against brute force over all pairs, and signatures against their promise."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import edge, empty, real

from rillstone.llm import spelling
from rillstone.llm.store import Scratch


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(counts):
    gone = {}
    for w in counts:
        for k in range(len(w) + 1):
            gone.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: {v for k in range(len(w) + 1) for v in gone[w[:k] + w[k + 1 :]] | ({w[:k] + w[k + 1 :]} & counts.keys()) | gone.get(w, set()) if is_near(w, v)} for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), n, len(near[w]), str(counts.get(form[w]))) for w, n in counts.items())


def told(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def test_real_documents(spark):
    docs = real(spark)
    counts = brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(counts) > 300
    assert told(spelling.variants(docs)) == brute(counts)


@pytest.mark.parametrize("small", [2, 32])
def test_chains_and_large_buckets(spark, small):
    """Chains of forms, ties, letters beyond ASCII, and many words that differ in one place, also with buckets split to the last letter."""
    rng = random.Random(5)
    counts = {"variant": 5000, "varriant": 900, "varrriant": 150, "varrrriant": 29, "varrrrriant": 5, "tieword": 50, "tiewordx": 50, "tiewords": 50, "tiewor": 5, "größen": 40, "grossen": 9, "groessen": 5, "größeñ": 6}
    counts |= {f"prefix{a}{b}": 5 for a in "abcdefgh" for b in "abcdefgh"} | {f"{a}suffixes": 6 + ord(a) for a in "abcdefghij"}
    counts |= {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))): rng.randint(5, 200) for _ in range(300)}
    docs = spark.createDataFrame([(None, " ".join([w] * n)) for w, n in counts.items()], "doc_id long, text string")
    want = brute_words([(None, " ".join([w] * n)) for w, n in counts.items()])
    assert told(spelling.variants(docs, small=small)) == brute(want)


@pytest.mark.parametrize("differ, first, second", [(2, 3, 1), (2, 1, 4), (2, 2, 3), (3, 2, 3)])
def test_signatures_meet(differ, first, second):
    """Multisets that differ in so many letters agree in a signature."""
    rng = random.Random(1)
    out = spelling.left_out(differ, first, second)
    for _ in range(300):
        x = [rng.choice(spelling.LETTERS) for _ in range(rng.randint(3, 12))]
        y, places = list(x), differ
        while places:
            if places >= 2 and rng.random() < 0.5:
                y[rng.randrange(len(y))] = rng.choice(spelling.LETTERS)
                places -= 2
            else:
                y.append(rng.choice(spelling.LETTERS)) if rng.random() < 0.5 else y.pop(rng.randrange(len(y)))
                places -= 1
        sign = lambda w, gone: sorted(c for c in w if c not in gone)
        assert any(sign(x, gone) == sign(y, gone) for gone in out)


def test_edges(spark):
    got = told(spelling.variants(edge(spark)))
    assert got == brute(brute_words([(r.doc_id, r.text) for r in edge(spark).collect()])) and got == []
    assert spelling.variants(empty(spark)).count() == 0
    many = spark.createDataFrame([(1, "Zebras zebras " * 3)] * 3, "doc_id long, text string")
    assert told(spelling.variants(many)) == [("zebras", "None", "zebras", 18, 0, "None")]


def test_scratch_is_cleared(spark, monkeypatch):
    left = []
    clear = Scratch.clear
    monkeypatch.setattr(Scratch, "clear", lambda self: (clear(self), left.extend(self.paths))[0])
    spelling.variants(real(spark).limit(20)).count()
    assert left == []
