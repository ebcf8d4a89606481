from __future__ import annotations

import random

import pytest

P = pytest.importorskip("public_tokenizers")
from archweave.llm.token_counts import _tokenizer, count_tokens, token_counts  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "the", "don't", " ", "  ", "\n", "\t", " \n", "é", "日本", "1234", "!?", "<|endoftext|>", "'s", " the", "x" * 50, "\r\n", "\x85", "\x1c", "​", "　", "²"]


def whole(text):
    return len(_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def test_pieces_count_as_the_whole():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    assert count_tokens(PATH, texts) == [whole(t) for t in texts]


def test_spliced_counts(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(PARTS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 400)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "letters" * 300), (53, " " * 900), (None, rows[5][1] * 3), (7, rows[7][1]), (54, "<|endoftext|>" * 90), (55, "ab " * 300 + "z" * 700 + " cd" * 200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, PATH, chunk=257, overlap=128).collect()]
    assert sorted(got, key=repr) == sorted(((d, len((t or "").encode()), whole(t)) for d, t in rows), key=repr)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
