from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storyline.llm import packing

HARD = ["", " ", "  a  b \n c\n\n d", "a b  c", "x <|endoftext|> y", "<|endoftext|>", "it's  we'll \t tab ", "é" * 3000, "1 2 3 " * 5000, "\n" * 50 + " x", "😀 😀  😀", "a " * 9000]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_tokenizers(spark, reference):
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    tokens = packing.Tokens()
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(tokens.of(text), "<u4").tolist() == want.ids, text[:80]


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "a" * 5_000_000, "x" + "\t" * 10_000 + "y" + "\n " * 1_000_000 + "z", " " * 9_999 + "x" + " " * 300_000, "word " * 1_000_000])
def test_very_long_texts(reference, text):
    assert np.frombuffer(packing.Tokens().of(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def held(rows, texts, reference):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        ids = reference.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded


@pytest.mark.parametrize("shard", [1 << 20, 5000])
def test_every_id_in_one_piece_and_no_padding(spark, reference, shard):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts |= {10**6 + i: t for i, t in enumerate([*HARD, None])}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, length int")
    held(packing.packed_pieces(df.repartition(3), shard=shard).collect(), texts, reference)


def test_costs_are_balanced():
    lengths = [int(x) for x in np.random.default_rng(5).lognormal(5.5, 1, 3000)]
    pieces = list(packing.packed(lengths))
    assert sum(n for _, _, n, _, _ in pieces) == sum(lengths)
    own = defaultdict(float)
    for i, _, n, k, _ in pieces:
        if n < 2048:
            own[k] += packing.cost(n)
    full = [c for k, c in own.items() if sum(p[2] for p in pieces if p[3] == k) == 2048]
    assert np.std(full) < 0.2 * np.mean(full)


def test_empty(spark):
    assert packing.packed_pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0
