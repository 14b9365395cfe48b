"""Token files and packing against the tokenizers library and exact round trips."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwright.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The the, THE; it's don't é Été ẞ ΣΣ naïve 中文 x y a b tab\tnew\nline", "a" * 3000, "||| ***a$$$ 123 4,5.6 ...!!", "<|endoftext|> a<|endoftext|>b", "", None, " \n", "\x1cz\x1fq", "İ İ fiﬁ \U0001f600\U0001f44d\U0001f3fd"]


def want(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents():
    rng = random.Random(1)
    words = ["word", "The", "of,", "l'eau", "café.", "ABC!", "x1"]
    return [*enumerate(TEXTS), *((20 + i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 700, 6000])))) for i in range(40))]


def test_words_encode_as_whole_texts():
    codec = tokens.WordCodec(PATH, most=5)
    for _ in range(2):
        assert [x.tolist() for x in codec.encode(TEXTS)] == [want(t) for t in TEXTS]


def test_files(spark):
    docs = documents()
    rows = tokens.token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), PATH).collect()
    start, expected = 0, set()
    for doc_id, text in sorted(docs):
        ids = want(text)
        expected.add((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in rows} == expected and len(rows) == len(docs)
    odd = spark.createDataFrame([(None, "a", 1), (5, "b", 2), (5, "b", 2)], "doc_id long, text string, ids int")
    assert sorted(tuple(r)[1:3] for r in tokens.token_files(odd, PATH).collect()) == [(0, 2), (2, 2), (4, 2)]
    assert tokens.token_files(odd.where("false"), PATH).collect() == []


def test_frames_seek_and_checksum():
    out = io.BytesIO()
    writer = tokens.FrameWriter(out, 2, frame=100)
    docs = [np.arange(n, dtype=np.uint32) + n for n in (0, 5, 99, 250, 1, 700)]
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    assert writer.finish() == (6, 1055)
    reader = tokens.FrameReader(pa.BufferReader(out.getvalue()), 2, frame=100)
    for k in (5, 0, 3, 1, 2, 4):
        assert reader.document(k).tolist() == docs[k].tolist()
    broken = bytearray(out.getvalue())
    broken[20] ^= 1
    with pytest.raises((ValueError, Exception)):
        tokens.FrameReader(pa.BufferReader(bytes(broken)), 2, frame=100).document(2)


def test_packing(spark):
    docs = documents()
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(r.ids) and r.length == len(r.ids)
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == want(text) and all(r.doc_tokens == len(want(text)) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_sum_of_squares_by_brute_force():
    rng = random.Random(2)
    packer = packing.SumOfSquares(16, most_open=1000)
    for _ in range(400):
        n = rng.randint(1, 15)
        counts = packer.counts.copy()

        def cost(level):
            new = counts.copy()
            new[level] -= level > 0
            new[level + n] += level + n < 16
            return int((new[1:16] ** 2).sum())

        levels = [h for h in range(1, 17 - n) if counts[h]] + [0]
        assert cost(packer.level_for(n)) == min(map(cost, levels))
        packer.place((1, 0, np.zeros(n, np.uint32), n))
