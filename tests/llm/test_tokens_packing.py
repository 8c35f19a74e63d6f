import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import edge, empty, real

from rillstone.llm import packing, tokenbin
from rillstone.llm.tokens import Encoder, vocabulary


@pytest.fixture(scope="module")
def plain():
    e = Encoder(vocabulary())
    return lambda t: e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts(plain):
    rng, enc = random.Random(1), Encoder(vocabulary(), entries=50)
    texts = ["".join(rng.choice(" \n\t\r  a'sZ9é!?.ñ中　\xa0​x<|endoftext|>'") for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None, "", "a b\n" * 200_000]
    assert all(got.tolist() == plain(t) for t, got in zip(texts, enc.each(texts), strict=True))
    assert enc("x  y\n").tolist() == plain("x  y\n") and enc.table.room == 0 and len(enc.kept) <= 50


def test_blocks_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 255, 256, 257, 3000):
        for pool in ([5], range(50_257), [0, 1, 2**32 - 1, 2**31, 7]):
            x = np.array([rng.choice(pool) for _ in range(n)], np.uint32)
            payload = tokenbin.pack(x)
            assert np.array_equal(tokenbin.unpack(payload), x) and np.array_equal(tokenbin.unpack(payload, 1, 2), x[256:512])
    skewed = np.array([rng.randrange(16) if rng.random() < 0.95 else 50_000 for _ in range(256 * 50)], np.uint32)
    assert len(tokenbin.pack(skewed)) < 256 * 50 * 1.2  # outliers don't widen their blocks
    with pytest.raises(ValueError):
        tokenbin.unpack(bytes(24))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("make", [edge, empty, real])
def test_files_read_back(spark, plain, make):
    df = make(spark)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenbin.read_tokens(spark, tokenbin.write_tokens(df, segment=500)).collect())
    want = Counter((i, zlib.crc32(np.array(plain(t) + [0], "<u4").tobytes())) for i, t in rows_of(df))
    assert Counter((i, c) for _, i, _, c in got) == want
    assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda i: (i is not None, i or 0))
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


@pytest.mark.parametrize("make, ranked", [(edge, 1000), (empty, 1000), (real, 1000), (real, 1)])
def test_packing_is_whole_and_tight(spark, plain, monkeypatch, make, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)  # 1: a salt for every piece
    df = make(spark)
    got = packing.pack_documents(df).collect()
    want = Counter()
    for i, t in rows_of(df):
        ids = np.array(plain(t) + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and sum(s[-1]) <= 1024 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:]))
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) * 1.05 + 1


def test_plan_matches_large_items_in_pairs():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        bins, large = defaultdict(int), Counter()
        seen = Counter()
        for size, lo, hi, first, each, at in packing.plan(counts):
            seen[size] += hi - lo
            for k in range(hi - lo):
                bins[first + k // each] += size
                large[first + k // each] += 3 * size > 1024
                assert at + k % each * size + size <= 1024
        assert seen == counts and max(bins.values()) <= 1024 and max(large.values()) <= 2
        assert sorted(bins) == list(range(len(bins)))
