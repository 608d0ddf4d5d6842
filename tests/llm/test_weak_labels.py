import re

import numpy as np
import regex
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from storyline.llm import weak_labels as w


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(40_000) < 0.7
    right, silent = [0.9, 0.8, 0.7, 0.95], [0.2, 0.5, 0.1, 0.4]
    votes = np.stack([np.where(rng.random(len(y)) < s, 0, np.where(rng.random(len(y)) < a, y, ~y) + 1) for a, s in zip(right, silent, strict=True)])
    code = sum(votes[k] * 3 ** (3 - k) for k in range(4))
    post, prob, share = w.label_model(dict(enumerate(np.bincount(code, minlength=81))), 4)
    assert abs(share - 0.7) < 0.02
    for k in range(4):
        for c in (0, 1):
            assert abs(prob[k, c, c + 1] / prob[k, c, 1:].sum() - right[k]) < 0.03
    assert ((post[code] > 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")  # never seen by the fit
    got = w.scored(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    rate = {r.quality: r.kept for r in got}
    assert rate[1] >= 0.97 and rate[0] <= 0.25


def test_odd_rows(spark):
    rows = [(1, None, 0.1), (2, "", 0.2), (3, "word " * 30_000, 0.3), (None, "a b c", None), (3, "word " * 30_000, 0.3), (4, "\n\n", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = w.scored(df).collect()
    assert sorted(map(str, [r.doc_id for r in got])) == sorted(map(str, [r[0] for r in rows]))
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert w.scored(df.limit(0)).count() == 0


def plain_measures(text):
    t = text or ""
    ws = [x for x in re.split("[\x20\x09-\x0d]+", t.lower()) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = max(1, len(ws))
    return ws, [
        len(ws), len("".join(ws)) / n, len(re.findall("[#*$%&|<>{}]", t)) / n, sum(x in set(w.STOP_WORDS) for x in ws) / n, (len(lines) - len(set(lines))) / max(1, len(lines)),
        len(regex.sub(r"\P{L}+", "", t)) / max(1, len(t)), sum(bool(re.search(r'[.!?…:;"»)]\s*$', x)) for x in lines) / max(1, len(lines)), len(set(ws)) / n,
    ]


def plain_votes(m):
    n, chars, symbols, stops, dups, letters, _, distinct = m
    vote = lambda bad, good: 1 if bad else 2 if good else 0
    return [
        vote(n < 8, n > 40), vote(symbols > 0.1, symbols < 0.02), vote(chars < 2.5 or chars > 14, 3.5 <= chars <= 9), vote(stops < 0.02, stops > 0.08), vote(dups > 0.3, dups == 0),
        vote(letters < 0.65, letters > 0.75), vote(distinct < 0.25, distinct > 0.45),
    ]


def plain_posteriors(votes):
    """Expectation-maximisation document by document."""
    v = np.array(votes)
    post = 1 / (1 + np.exp(-((v == 2).sum(1) - (v == 1).sum(1)).astype(float)))
    for _ in range(200):
        share = (post.sum() + 1) / (len(v) + 2)
        like = np.ones((len(v), 2))
        for k in range(v.shape[1]):
            for y, p in ((0, 1 - post), (1, post)):
                counts = np.array([p[v[:, k] == x].sum() + 1 for x in range(3)])
                like[:, y] *= (counts / counts.sum())[v[:, k]]
        before, post = post, 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + np.log(like[:, 1] / like[:, 0]), -30, 30)))
        if abs(post - before).max() < 1e-9:
            break
    return post


def test_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "a b c"), (9003, "Word " * 3000 + "#" * 50), (9003, "Word " * 3000 + "#" * 50)], docs.schema))
    rows = docs.collect()
    measured = [plain_measures(r.text) for r in rows]
    votes = [plain_votes(m) for _, m in measured]
    posterior = plain_posteriors(votes)
    _, model = w.fit(docs)
    index, weight = HashingTF(numFeatures=w.BUCKETS).indexOf, model.coefficients.toArray()
    want = []
    for r, (ws, m), v, p in zip(rows, measured, votes, posterior, strict=True):
        x = np.zeros(w.BUCKETS)
        for word in ws:
            x[index(word)] += 1
        x /= np.linalg.norm(x) or 1
        dense = [np.log1p(m[0]) / 8, min(3, m[1] / 8), *[min(3, y) for y in m[2:]]]
        score = 1 / (1 + np.exp(-(weight[: w.BUCKETS] @ x + weight[w.BUCKETS :] @ dense + model.intercept)))
        want.append((r.doc_id, sum(y * 3 ** (6 - k) for k, y in enumerate(v)), p, score))
    got = [(r.doc_id, r.votes, r.posterior, r.score, r.kept) for r in w.scored(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and abs(a[3] - b[3]) < 1e-3, (a, b)
        assert a[4] == (a[3] >= w.THRESHOLD)


def test_rows_without_ids_and_copies_keep_the_sample_bounded(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("words of text "), (F.col("id") % 2000).cast("string")).alias("text"))
    sizes = []
    real = w.checkpointed
    monkeypatch.setattr(w, "checkpointed", lambda df: sizes.append((out := real(df)).count()) or out)
    w.fit(docs, sample=100)
    assert 0 < sizes[0] <= 2 * 150
