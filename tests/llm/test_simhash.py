import random
import re

import xxhash
from helpers import edge, empty, real
from pyspark.sql import functions as F

from rillstone.llm import components, simhash, store


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    least = dict.fromkeys(prints)
    top = {k: k for k in prints}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in least}


def test_fingerprints(spark):
    texts = [None, "", "one", "Two Words", "ÀB c\x0bd　e f", "a b c " * 50]
    assert [simhash.fingerprint(t) for t in texts] == [brute(t) for t in texts]


def test_masks_cover_every_pair_within_the_radius():
    for free in ((1 << 64) - 1, 0x0F0F_1234_8001_0FF1, 0x7F):
        masks = simhash.covering_masks(2, free)
        places = [i for i in range(64) if free >> i & 1]
        for i in places:
            for j in places:
                diff = 1 << i | 1 << j
                assert any(not m & diff for m in masks) and all(m & free == m > 0 for m in masks)


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(1)
    prints = {}
    for k in range(400):  # chains of near values, and strangers
        base = prints[rng.randrange(k)] if k and rng.random() < 0.8 else rng.getrandbits(64)
        prints[k] = base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    for k in range(400, 1000):  # large buckets: all within 12 free bits, and around one value
        prints[k] = 0xABCD << 40 | rng.getrandbits(12) << 3 if k % 2 else 0x5A5A5A5A ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    signed = simhash._signed
    df = spark.createDataFrame([(signed(v), k) for k, v in prints.items()], "fp long, doc_id long")
    want = brute_groups(prints)
    values = sorted(set(prints.values()))
    pairs = {(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    for most in (0, 8, 2000):
        links = simhash.links(df.select("fp").distinct(), most=most)
        found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()]
        assert len(found) == len(pairs) and {(max(p), min(p)) for p in found} == pairs
        got = components.components(links)
        rows = df.join(got, df.fp == got.node, "left").select("doc_id", F.coalesce("component", "fp").alias("c")).collect()
        mine = {}
        for r in sorted(rows, key=lambda r: r.doc_id):
            mine.setdefault(r.c, r.doc_id)
        assert {r.doc_id: mine[r.c] for r in rows} == want


def test_radius_of_three(spark):
    rng = random.Random(4)
    values = sorted({0x123456789 ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)})
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    want = sum((a ^ b).bit_count() <= 3 for i, a in enumerate(values) for b in values[:i])
    assert simhash.links(df, radius=3, most=4).count() == want > 100


def test_hot_fingerprints(spark, monkeypatch):
    """A third of all rows has fingerprint 0; keys above the share are joined map-side."""
    calls = []
    real_split = store.join_split
    split = lambda rows, of, key, **_: calls.append(key) or real_split(rows, of, key, share=0.01, floor=5)
    monkeypatch.setattr(simhash, "join_split", split)
    monkeypatch.setattr(components, "join_split", split)
    texts = [(k, "" if k % 3 == 0 else f"w{k % 7} of some few words" if k % 3 == 1 else f"text {k} has its own {k * k} words") for k in range(300)]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    prints = {k: brute(t) for k, t in texts}
    assert {k: r.component_id for k, r in got.items()} == brute_groups(prints) and {"fp", "key"} <= set(calls)


def test_components_of_a_star(spark):
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    split = store.join_split(hub, hub.groupBy("a").agg(F.max("b").alias("m"), F.count("*").alias("rows")), "a", floor=10)
    assert split.count() == 2999 and {r.m for r in split.collect()} == {2999}
    assert {r.component for r in components.components(hub).collect()} == {0}


def test_real_documents(spark):
    docs = real(spark)
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    prints = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == brute_groups(prints)


def test_edges(spark):
    got = simhash.near_groups(edge(spark)).collect()
    assert len(got) == 11 and {r.component_id for r in got if r.fp == 0} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 8)} == {5}
    kept = simhash.drop_near(edge(spark))
    assert kept.columns == edge(spark).columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 5, 7}
    assert simhash.near_groups(empty(spark)).count() == 0 and simhash.drop_near(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.component) for r in components.components(links).collect()} == {1}
    assert components.components(links.limit(0)).count() == 0
