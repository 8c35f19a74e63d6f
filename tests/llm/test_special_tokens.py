import zlib

import numpy as np
from tokenizers import Tokenizer

from rillstone.llm import chat, packing, tokenbin
from rillstone.llm.tokens import Encoder, encoder, vocabulary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "a  \n<|endoftext|>  b c<|endoftext|>d", "plain text", "<|endoftext| >", "x y\n" * 300_000 + "<|endoftext|> z"]


def test_literals_of_special_tokens_have_the_librarys_ids(spark):
    fresh = Tokenizer.from_file(vocabulary())
    want = [fresh.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in Encoder(vocabulary()).each(TEXTS)] == want
    df = spark.createDataFrame(list(enumerate(TEXTS[:5])), "doc_id long, text string")
    crc = lambda ids, end: zlib.crc32(np.array([*ids, end], "<u4").tobytes())
    files = tokenbin.read_tokens(spark, tokenbin.write_tokens(df)).collect()
    assert {r.doc_id: r.ids_crc32 for r in files} == {i: crc(x, 0) for i, x in enumerate(want[:5])}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack_documents(df).collect()} == {i: crc(x, 2) for i, x in enumerate(want[:5])}


def test_chats_take_them_as_text(spark):
    assert encoder(plain=True)("a <|endoftext|> b").tolist() == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]
    turns = spark.createDataFrame([(1, 0, "user", TEXTS[0])], "conv_id long, turn long, role string, text string")
    assert 50256 not in chat.format_turns(turns).first().ids
