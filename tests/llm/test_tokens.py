import random

import pytest

from trailspark.llm import tokens as t

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    import os

    tok = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(t.default_ranks()), "byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda x: tok.encode(x or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_the_whole_text(spark, whole):
    rng = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "9", "!!", "'", "-", " ", " ", "😀", "<|endoftext|>", "字", "\x1c"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 900, 4000])))) for i in range(30)]
    rows += [(100, "x" * 7000), (101, " " * 7000), (102, "a " * 3000 + "y" * 4000 + " z" * 2000), (103, None), (104, ""), (100, "x" * 7000), (None, "null id " * 500), (105, "q" * 100 + " " * 3000 + "'s" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids", "'clash' as part", "1 as doc")
    key = lambda d: -1 if d is None else d
    want = sorted((key(d), whole(x)) for d, x in rows)
    for chunk in (1500, 16_000):
        got = sorted((key(r.doc_id), r.ids) for r in t.encode(df, "doc_id", "text", chunk=chunk).collect())
        assert got == want
    assert all(t.decode(ids) == (x or "") for (d, x), ids in zip(rows, (whole(x) for _, x in rows)))


def test_nothing(spark):
    assert t.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
