import random

import corpus_pipeline as cp
import pytest
from helpers import edge, empty, real
from pyspark.sql import functions as F

from rillstone.llm import nearcopies, store


def brute(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets, top = {k: brute(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def planted():
    """Chains of edits, a large group of near copies, a common passage, and strangers."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    out = [[word() for _ in range(rng.randint(1, 120))] for _ in range(60)]
    for _ in range(140):
        t = list(rng.choice(out))
        for _ in range(rng.choice((1, 1, 2, 4))):
            t[rng.randrange(len(t))] = word()
        out.append(t)
    base, passage = [word() for _ in range(150)], [word() for _ in range(90)]
    out += [[*base[:k], word(), *base[k + 1 :]] for k in range(40, 80)]
    out += [[*passage, *[word() for _ in range(rng.randint(4, 25))]] for _ in range(60)]
    return [(k, " ".join(t)) for k, t in enumerate(out)]


@pytest.mark.parametrize("pairs, block, hot", [(1000, 64, False), (3, 5, True)])
def test_planted_groups(spark, monkeypatch, pairs, block, hot):
    """Also with hubs split by salts, small blocks of rows and hot keys joined map-side."""
    monkeypatch.setattr(nearcopies, "PAIRS", pairs)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    if hot:
        monkeypatch.setattr(nearcopies, "join_split", lambda rows, of, key: store.join_split(rows, of, key, share=0.01, floor=3))
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert 20 < len(set(want.values())) < len(want) - 100
    assert {r.doc_id: r.component_id for r in nearcopies.near_groups(df).collect()} == want
    assert {r.doc_id for r in cp.drop_near_copies(spark, df, "").collect()} == set(want.values())


def test_real_documents(spark):
    docs = real(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.component_id for r in nearcopies.near_groups(docs).collect()} == brute_groups(rows)


def test_edges(spark):
    got = nearcopies.near_groups(edge(spark)).collect()
    assert len(got) == 11 and {r.component_id for r in got if r.doc_id in (1, 2, 6)} == {1}
    kept = nearcopies.drop_near(edge(spark))
    assert kept.columns == edge(spark).columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 5, 7}
    assert nearcopies.near_groups(empty(spark)).count() == 0


def test_fingerprints_bring_near_copies_together(spark, tmp_path):
    """Op4's masks find sets whose SimHash is within its radius, as a first stage of its own."""
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(400)]
    sets = [nearcopies.shingles(" ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(10)] + [nearcopies.shingles(" ".join(f"v{i}" for i in range(300)))]
    prints = [nearcopies.fingerprint(s) for s in sets]
    classes = spark.createDataFrame(list(enumerate(prints)), "sig long, fp long")
    got = nearcopies._by_fingerprint(classes, store.Scratch(spark))
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    near = {(a, b) for a in range(11) for b in range(a + 1, 11) if bits(prints[a], prints[b]) <= 2}
    assert near and not any(b == 10 for _, b in near)
    assert {(r.a, r.b) for r in got.filter(F.col("a") < F.col("b")).collect()} <= near
    assert {frozenset(x) for x in ((r.a, r.b) for r in got.collect())} == {frozenset((a, b)) for a, b in near if prints.index(prints[a]) == a and (prints[a] == prints[b] or prints.index(prints[b]) == b)}


def test_parities_tell_long_texts_apart():
    """Two texts of 12,000 words that share a fifth of them are no plausible pair in a block either."""
    x, y = (nearcopies.shingles(" ".join(f"{p if i > 2400 else 'c'}{i}" for i in range(12_000))) for p in "ab")
    bits = [nearcopies.folded(nearcopies.parities(s), nearcopies.BRIEF) for s in (x, y)]
    assert int(nearcopies.np.bitwise_count(bits[0] ^ bits[1]).sum()) > nearcopies.radius(len(x), len(y))


def test_few_candidates_of_a_large_group(spark, monkeypatch):
    """A group in which many pairs are similar, if no common head links them, is joined by about as many candidates as it has sets."""
    rng, base, sets = random.Random(5), [f"w{i}" for i in range(150)], 90
    places = [(rng.randrange(10, 70), rng.randrange(80, 140))[: 2 - k % 2] for k in range(sets)]  # two edits or one, which alone is similar to the others
    texts = [" ".join(f"e{k}-{i}" if i in at else w for i, w in enumerate(base)) for k, at in enumerate(places)]
    rows = list(enumerate(texts))
    given, inner = [], nearcopies._verified

    def verified(pairs, *others):
        given.append(pairs.distinct().count())
        return inner(pairs.limit(0) if len(given) == 1 else pairs, *others)

    monkeypatch.setattr(nearcopies, "_verified", verified)
    monkeypatch.setattr(nearcopies, "_by_fingerprint", lambda classes, step: spark.createDataFrame([], "a long, b long"))
    got = nearcopies.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(rows) == dict.fromkeys(range(sets), 0)
    assert len(given) > 1 and 0 < sum(given[1:]) < 5 * sets


def test_the_order_knows_keys_of_few_sets(spark, monkeypatch):
    """Where the sample is a small part of the texts, shingles in a few sets of every fourth text are known too, below those of the sample, and the groups are the same."""
    monkeypatch.setattr(nearcopies, "SAMPLE", 50)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    known, places, floor = nearcopies._frequent(made)
    assert floor >= nearcopies.OFTEN and (known[1:] > known[:-1]).all() and (places <= floor).any() and (places > floor).any()
    first, cold = nearcopies.keys(known, (known, places, floor))
    assert cold == min(len(first), int((places <= floor).sum()))
    assert {r.doc_id: r.component_id for r in nearcopies.near_groups(df).collect()} == brute_groups(rows)
