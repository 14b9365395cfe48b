"""Merge replay against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomwright.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    some = ["", None, "Hello world's  test\n\n x", "aaaaaaaaaaaaaaaaaaa" * 50, "ababababab" * 40, "中文字符 é́ ñandú Straße", "\x00\x01 \x1c ", "🙂👍🏽" * 9, "<|endoftext|> x", "1234567890 3.14", "!!!???###" * 30, "   \n\t  a"]
    letters = "abcdeé ñ'.\n0"
    return some + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["".join(chr(rng.choice([97, 98, 99, 233, 0x4E2D, 0x1F600])) for _ in range(300)) for _ in range(20)]


def test_ids_and_bytes(ranks):
    encoder, wanted = bpe.Encoder(ranks, public_tokenizers.PATTERN, most=50), library(ranks)
    for _ in range(2):
        for text, ids in zip(texts(), encoder.encode(texts())):
            assert ids.tolist() == wanted.encode_ordinary(text or "")
            assert encoder.replay.decode(ids) == (text or "").encode()


def test_order_within_a_word():
    """A vocabulary in which a merge makes a pair of a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"ab", b"bx", b"abab", b"aba"]
    ranks = {t: r for r, t in enumerate(tokens)}
    wanted = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    rng = random.Random(1)
    words = ["".join(rng.choice("abx") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    ids, counts = replay.encode([w.encode() for w in words])
    for word, part in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == wanted.encode_ordinary(word), word


def test_query(spark, ranks):
    docs = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (0, ""), (0, "")]
    rows = bpe.encode_documents(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_tokens"), RANKS, public_tokenizers.PATTERN).collect()
    wanted = library(ranks)
    got = sorted(map(tuple, rows), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((d, len(i), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in docs for i in [wanted.encode_ordinary(t or "")]), key=str)
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect() == []
