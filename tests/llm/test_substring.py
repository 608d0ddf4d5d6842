from collections import Counter

import pytest

from storyline.llm import substring


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().split()
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("batch_words", [1 << 20, 3000])
def test_equals_brute_force(spark, monkeypatch, batch_words):
    monkeypatch.setattr(substring, "BATCH_WORDS", batch_words)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{k}" for k in range(400))
    piece = " ".join(f"w{k}" for k in range(100, 149))
    hard = [(None, long), (-5, long), (10**9, "x " + long), (10**9, "y y " + long + " z"), (10**9 + 1, piece + " w149 tail"), (10**9 + 2, piece + " other"), (10**9 + 3, None), (10**9 + 4, " \n\t")]
    hard += [(10**9 + 5, "spam " * 700), (10**9 + 6, "spam " * 51), (10**9 + 7, "Spam " * 51), (10**9 + 8, "é\xa0w " * 60), (10**9 + 9, "q " * 49)]
    rows += hard + hard[2:6]
    df = spark.createDataFrame([(*r, "t", 1, b"z") for r in rows], "doc_id long, text string, tag string, pos int, z binary")
    assert Counter(map(tuple, substring.remove_repeats(df).collect())) == Counter(brute(rows))


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
