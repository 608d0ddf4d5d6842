from collections import Counter, defaultdict
from math import ceil, log

import pytest
from pyspark.sql import functions as F

from storyline.llm import mixing
from storyline.llm.mixing import Mix, mixed, source_tokens, weights

def tokens():
    return F.col("n")


def table(spark, sources):
    rows = [(s, f"{s}{i}", 3 + (7 * i) % 11) for s, n in sources.items() for i in range(n)]
    return spark.createDataFrame([(k, s, n, "x") for k, (s, _, n) in enumerate(rows)], "doc_id long, source string, n int, c string")


@pytest.mark.parametrize("mix", [Mix(), Mix(max_repeats=4, entropy=0.9), Mix(max_repeats=1), Mix(budget=3000, max_repeats=1.5), Mix(entropy=0.5, max_repeats=9)])
def test_weights_keep_to_the_mix(spark, mix):
    df = table(spark, {"a": 700, "b": 60, "c": 25, "d": 200, None: 90})
    got = weights(source_tokens(df, "source", tokens()), mix).collect()
    assert abs(sum(r.weight for r in got) - 1) < 1e-9
    t = {r.source: r.n_tokens for r in got}
    total = sum(t.values())

    def at(a):
        z = sum((x / total) ** a for x in t.values())
        w = {s: (x / total) ** a / z for s, x in t.items()}
        budget = mix.budget or max(t.values()) / max(w.values())
        entropy = -sum(x * log(x) for x in w.values())
        return w, max(budget * w[s] / t[s] for s in t) <= mix.max_repeats * (1 + 1e-9) and (mix.entropy is None or entropy <= mix.entropy * log(len(t)) + 1e-9)

    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        low, high = (low, a) if at(a)[1] else (a, high)
    want = at(high)[0]
    assert all(abs(r.weight - want[r.source]) < 1e-6 for r in got)
    assert max(r.passes for r in got) <= mix.max_repeats + 1e-8
    if mix.budget is None:
        assert min(r.passes for r in got) >= 1 - 1e-8


@pytest.mark.parametrize("bucket", [7, 5000])
def test_blocks_equal_a_plain_walk(spark, bucket):
    df = table(spark, {"a": 700, "b": 60, "c": 25, None: 90})
    df = df.unionByName(df.where("doc_id % 97 = 0")).unionByName(spark.createDataFrame([(10**6, "zero", 0, "x"), (None, "a", 5, None)], df.schema))
    mix = Mix(max_repeats=2.5, blocks=8, bucket_docs=bucket)
    got = mixed(df, tokens=tokens(), mix=mix)
    assert got.columns == [*df.columns, "mix_pass", "mix_block", "mix_order", "mix_tokens"]
    rows = got.collect()
    w = {r.source: r for r in weights(source_tokens(df, "source", tokens()), mix).collect()}
    keyed = df.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("p"))).withColumn("k", mixing.key(F.col("doc_id"), F.col("p"), mix.seed)).collect()
    own = defaultdict(list)
    for r in keyed:
        own[r.source, r.p].append(r)
    want = Counter()
    for (s, p), docs in own.items():
        if s not in w:
            want.update((r.doc_id, s, p, 0) for r in docs if p == 0)
        elif p < ceil(w[s].passes):
            for r in docs:
                before = p * w[s].n_tokens + sum(x.n for x in docs if x.k < r.k)
                part = before / (w[s].passes * w[s].n_tokens)
                if part < 1:
                    want[r.doc_id, s, p, int(part * 8)] += 1
    assert Counter((r.doc_id, r.source, r.mix_pass, r.mix_block) for r in rows) == want
    for b in range(8):  # each block has the sources in their weights
        t = Counter()
        for r in rows:
            if r.mix_block == b:
                t[r.source] += r.n
        for s, r in w.items():
            assert abs(t[s] / sum(t.values()) - r.weight) < 0.06


def test_empty(spark):
    assert mixed(spark.createDataFrame([], "doc_id long, source string, n int"), tokens=tokens()).count() == 0
    assert mixed(spark.createDataFrame([(1, "a", None)], "doc_id long, source string, n int"), tokens=tokens()).count() == 1
