import re
from array import array
from collections import Counter, defaultdict
from zlib import crc32

import corpus_pipeline as p
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyline.llm import quality_rules
from storyline.llm.common import words
from storyline.llm.mixing import Mix, key, source_tokens, weights

from .test_quality_rules import brute as rated
from .test_simhash import brute as grouped
from .test_spans import base_secrets, entropy_spans


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    sf, folder, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages_equal_brute_force(spark, outputs):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    kept = {r[0] for r in rated(rows, quality_rules.Limits()) if r[8]}
    first = {r.doc_id: r for r in outputs[0].collect()}
    assert set(first) == kept
    second = {r.doc_id: r for r in outputs[1].collect()}
    assert set(second) == {d for d, _, c in grouped([(i, r.text) for i, r in first.items()]) if d == c}
    third = {r.doc_id: r for r in outputs[2].collect()}
    assert set(third) == set(second)
    for i, r in second.items():
        spans = sorted((a, b) for a, _, b in base_secrets(r.text) + entropy_spans(r.text))
        text, at = "", 0
        for a, b in spans:
            if a >= at:
                text += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        assert third[i].text == text + r.text[at:]
        assert third[i].n_chars == len(third[i].text)
    fourth = Counter(r.doc_id for r in outputs[3].collect())
    # mixing: the weights' passes over each source, in the order of the permutation's keys
    mix = Mix(max_repeats=2.0)
    n = {i: len([w for w in re.split("[\x20\x09-\x0d]+", r.text) if w]) for i, r in third.items()}
    total = Counter()
    for i, r in third.items():
        total[r.source] += n[i]
    weighed = {r.source: r.passes for r in weights(source_tokens(outputs[2], "source", F.size(words(F.col("text")))), mix).collect()}
    keyed = outputs[2].select("doc_id", "source", key(F.col("doc_id"), F.lit(0), mix.seed).alias("k0"), key(F.col("doc_id"), F.lit(1), mix.seed).alias("k1")).collect()
    want = Counter()
    for s in total:
        for p_ in (0, 1):
            before = p_ * total[s]
            for r in sorted((r for r in keyed if r.source == s), key=lambda r: r[2 + p_]):
                if before < weighed[s] * total[s] - 1e-6:
                    want[r.doc_id] += 1
                before += n[r.doc_id]
    assert fourth == want and set(fourth) == set(third) and max(fourth.values()) <= 2
    assert all(x.columns == p.COLUMNS for x in outputs[:-1])
    pieces = outputs[4].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] * fourth[r.doc_id] for r in pieces) and len(pieces) == len(fourth)


def test_packing_holds_the_mixed_documents(outputs):
    """Every id of every document in one piece, checked against the tokenizer, and full sequences or powers of two."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in outputs[3].collect()}
    copies = Counter(r.doc_id for r in outputs[3].select("doc_id").collect())
    covered, sequences = Counter(), defaultdict(list)
    for r in outputs[4].collect():
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == crc32(array("I", ids).tobytes()) and r.doc_tokens == len(texts[r.doc_id])
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({(i, k): copies[i] for i, ids in texts.items() for k in range(len(ids))})
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_run_equals_the_stages(spark, outputs):
    told = lambda df: Counter(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    assert told(p.run(spark, "/root/testdata/sf0.001")) == told(outputs[4])


def test_import_errors_are_not_swallowed():
    assert not re.search("except ImportError", open(p.__file__).read())
