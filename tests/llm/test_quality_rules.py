import re
import zlib
from collections import Counter

import numpy as np
from helpers import edge, empty, labels, real
from pyspark.sql import functions as F

from rillstone.llm import quality, queries, rules


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_quality(spark, sf).collect()
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in y]
    good, bad = ([r.score for r in held if y[r.doc_id] == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    accuracy = np.mean([r.predicted == y[r.doc_id] for r in held])
    print(f"held out: {len(held)} documents, AUC {auc:.4f}, accuracy {accuracy:.4f}")
    assert len(held) > 900 and auc > 0.99 and accuracy > 0.98


def test_nothing_but_pooled_vectors(spark):
    model = quality.fit(real(spark), labels(spark))
    assert len(model.features("some text")) == model.vectors.shape[1] + model.orders.shape[1]
    a, b = model.features("the of and in " * 40), model.features("the of and in ")
    assert np.allclose(a[: model.vectors.shape[1]], b[: model.vectors.shape[1]])
    width = model.vectors.shape[1]
    assert model.features("qqq " * 50)[width:].min() == 1.0 and abs(model.features(" ".join(f"zz{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)))[width:]).max() < 0.3
    long = "zebra of " * 100_000
    assert np.allclose(model.features(long)[width:], model.features("zebra of " * 500)[width:], atol=1e-2)


def test_scores_depend_on_the_text_alone_and_repeat(spark):
    docs, lab = real(spark), labels(spark)
    a, b = quality.fit(docs, lab), quality.fit(docs.repartition(5), lab)
    texts = [None, "", "The and of. " * 30, "A!! B!! " * 30, "x" * 50_000]
    assert np.allclose(a.score(texts), b.score(texts)) and a.score(texts)[0] == a.score(texts)[1]
    scored = quality.scored(edge(spark), a)
    assert scored.count() == 11 and scored.filter("score is null").count() == 0 and quality.scored(empty(spark), a).count() == 0


def test_columns_of_the_same_name_are_carried(spark):
    """A column that is called score, or as a helper, comes back as it was."""
    model = quality.fit(real(spark), labels(spark))
    df = edge(spark).withColumn("rillstone_score", F.lit("mine")).withColumn("row", F.lit("r"))
    assert {(r.row.score, r.row.rillstone_score, r.row.row) for r in quality.scored(df, model).collect()} == {("s", "mine", "r")}
    kept = quality.keep(df, model, cut=0.0)
    assert kept.columns == df.columns and kept.count() == 11 and {r.score for r in kept.collect()} == {"s"}
    assert quality.keep(df, model, cut=1.1).count() == 0


def test_without_labels_scores_are_the_share(spark):
    lab = labels(spark)
    assert quality.fit(real(spark), lab.limit(0)).score(["a"]).tolist() == [0.5]
    assert quality.fit(real(spark), lab.filter("quality = 1")).score(["a"]).tolist() == [1.0]
    assert quality.fit(empty(spark), lab).weights == ()


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_plain_counts(spark):
    texts = [r.text for r in real(spark).select("text").collect()] + [None, "", "a a a a", "a b c a b c d", "x\n\nx\n \nx", "\xa0\n\xa0", "a | b <c>"]
    assert [rules.plain(t) for t in texts] == [brute(t) for t in texts]


def test_ratio_counts_every_document(spark):
    docs, lab = real(spark), labels(spark)
    ratio = rules.ratios(docs, lab)
    good = {r.doc_id for r in lab.filter("quality = 1").collect()}
    counts = np.zeros((2, 1 << rules.BITS))
    for r in docs.select("doc_id", "text").collect():
        for x in rules.hashed(r.text):
            k = np.bincount(x, minlength=counts.shape[1])
            counts[0] += k
            counts[1] += k * (r.doc_id in good)
    log = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1]))
    assert np.allclose(ratio, log[1] - log[0])
    b = np.frombuffer("abcdé".encode(), np.uint8).astype(np.uint32)
    want = [(int(b[i]) | int(b[i + 1]) << 8 | int(b[i + 2]) << 16) * 2654435761 % 2**32 >> 18 for i in range(len(b) - 2)]
    assert next(rules.hashed("abcdé")).tolist() == want


def test_verdicts(spark):
    lab = labels(spark)
    got = {(r.doc_id, r.n_words): r for r in rules.judge(edge(spark), lab).collect()}
    assert not any(r.kept for r in got.values()) and got[(1, 0)].base_failed and got[(5, 18000)].base_failed
    assert rules.judge(empty(spark), lab).count() == 0
    ratio = rules.ratios(real(spark), lab)
    texts = {r.doc_id: r.text for r in real(spark).select("doc_id", "text").collect()}
    for r in rules.judge(real(spark), lab).collect():  # the verdict of every row, by brute force
        words, _, _, _, repeats = brute(texts[r.doc_id])
        b = (texts[r.doc_id] or "").encode()
        grams = [(b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 % 2**32 >> 18 for i in range(len(b) - 2)]
        llr = sum(ratio[g] for g in grams) / len(grams) if grams else 0.0
        failed = words < 50 or 100 * repeats > 50 * words
        assert (r.base_failed, r.kept) == (failed, not failed and llr >= -0.5) and abs(r.llr - llr) < 1e-9
    told = rules.judge(real(spark), lab).join(lab, "doc_id")
    good = told.filter("quality = 1 and not base_failed")
    assert good.count() and good.filter("not kept").count() == 0
    assert rules.judge(real(spark), lab.limit(0)).filter(F.col("kept") == F.col("base_failed")).count() == 0
