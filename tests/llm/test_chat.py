import hashlib
import random

import pytest

from rillstone.llm import chat
from rillstone.llm.tokens import encoder, vocabulary


def test_escapes_are_reversible():
    rng = random.Random(2)
    parts = ["\\", "<turn>", "</role>", "</turn>", "a", " ", "\n", "<", "/", "é", "<|endoftext|>", "'s", "\r\n", "　", " ", "### Assistant: "]
    enc = encoder(vocabulary())
    decode = lambda x: enc.tokenizer.decode(x, skip_special_tokens=False) if x else ""
    first = chat.FIRST_CONTROL
    for _ in range(3000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in "ab")
        kept = chat.escape(text)
        assert chat.unescape(kept) == text
        ids, loss = chat.assemble([(first, False), (enc(chat.escape(role)), False), (first + 1, False), (enc(kept), True), (first + 2, False)])
        assert chat.read_turn(ids, loss, decode) == (role, text, text) and loss.sum() == len(enc(kept))


def test_mask_by_prefix_sums():
    import numpy as np

    ids, loss = chat.assemble([(7, False), (np.array([1, 2], "<u4"), True), (8, True), (np.empty(0, "<u4"), True), (9, False)])
    assert ids.tolist() == [7, 1, 2, 8, 9] and loss.tolist() == [False, True, True, True, False]


def test_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (1, None, "user", "z"), (None, 0, "assistant", ""), (2, 5, "user", "x " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    made = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == digest("user\nz\n" + "\n\n" + "assistant\nb\n" * 2)
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, digest("bb")) and got[None].loss_chars == 0
    starts = [(r.n, r.char_start, r.token_start) for r in made.filter("conv_id = 1").orderBy("n").collect()]
    assert starts[0] == (0, 0, 0) and starts[-1][1] == sum(len(r.rendered) for r in made.filter("conv_id = 1 and n < 3").collect())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_closing_ids_can_be_learnt(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    made = chat.format_turns(df, end_in_loss=True)
    assert made.first().loss[-1] and chat.read_back(made).first().loss_chars == 1
    with pytest.raises(ValueError):
        import numpy as np

        chat.read_turn(np.array([1, 2]), np.array([False, False]), str)
