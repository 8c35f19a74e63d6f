import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from helpers import edge, empty
from pyspark.sql import functions as F

from rillstone.llm import exact, mixing


def test_groups_of_edge_rows(spark):
    got = exact.exact_groups(edge(spark)).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.digest].append(r)
    assert len(got) == 11 and all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in groups.values())
    same = groups[hashlib.sha256(b"same text here").hexdigest()]
    assert len(same) == 4 and {r.keep_id for r in same} == {4} and [r.doc_id for r in same if r.kept] == [4]
    assert {r.doc_id for r in groups[hashlib.sha256(b"").hexdigest()]} == {1, 2}
    assert exact.exact_groups(empty(spark)).count() == 0


def test_frequent_digests_meet_no_shuffle_limit(spark):
    """Groups above and below the heavy-hitter bound are told alike, one repeated row in a third of the table too."""
    rows = [(k, "hot") for k in range(300)] + [(7, "hot")] * 300 + [(k, f"t{k % 200}") for k in range(1000, 1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for support in (0.5, 1e-3):
        got = exact.exact_groups(df, support=support).groupBy("digest").agg(F.sum(F.col("kept").cast("int")).alias("k"), F.max("keep_id").alias("m"), F.max("group_size").alias("n"), F.count("*").alias("c")).collect()
        assert all(r.k == 1 and r.n == r.c for r in got) and len(got) == 201
        assert max((r.n, r.m) for r in got) == (600, 299)


def test_drop_keeps_one_of_each(spark):
    df = edge(spark)
    got = exact.drop_exact(df)
    assert got.columns == df.columns and got.count() == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact.drop_exact(empty(spark)).count() == 0
    mapped = df.withColumn("extra", F.create_map(F.lit("k"), F.col("n_chars")))  # a map can't be ordered
    assert exact.drop_exact(mapped).count() == got.count()


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_targets_by_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 100, "c": 1000, None: 5}, {"x": 0, "y": 7}, {"k": 3}, {f"s{i}": (i * 37) % 91 for i in range(30)}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_rates(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_many_sources(spark):
    """100,000 sources, ranked and filled without a window over all of them."""
    rng = random.Random(6)
    sizes = {f"host{k}.example": int(rng.paretovariate(0.7)) for k in range(100_000)} | {None: 12_345}
    schema = "source string, size long"
    got = {r.source: r.target for r in mixing.source_rates(spark.createDataFrame(list(sizes.items()), schema)).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    size = np.array([sizes[s] for s in order], float)
    weight = np.resize((5.0, 2.0, 1.0), len(order))
    open_, target = np.ones(len(order), bool), np.zeros(len(order))
    while True:
        share = (1.5 * size.sum() - target[~open_].sum()) / weight[open_].sum() * weight
        over = open_ & (share > 2 * size)
        if not over.any():
            break
        target[over], open_[over] = 2 * size[over], False
    target[open_] = share[open_]
    assert np.allclose([got[s] for s in order], target) and open_.sum() > 3


def test_taken_words_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plan = mixing.mix_plan(docs)
    told = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("squares")).collect()
    for r in told:  # the copies drawn vary by at most half a document each
        assert r.taken <= 2 * r.size and abs(r.taken - r.target) <= 4 * 0.5 * r.squares**0.5
    assert abs(sum(r.taken for r in told) / sum(r.target for r in told) - 1) < 0.02


def test_mix_is_repeatable_and_bounded(spark, monkeypatch):
    df = edge(spark)
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == 11 and all(r.copies <= 2 for r in plan) and {r.size for r in plan if r.doc_id in (1, 2, 6)} == {0}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    want = Counter()
    for r in plan:
        want[(r.doc_id, r.source)] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the shuffled way
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.mix_plan(df).collect()) == key(plan)
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_main_paths_are_native(spark):
    for df in (exact.exact_groups(edge(spark)), mixing.mix_plan(edge(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
