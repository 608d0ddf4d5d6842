import math
from collections import defaultdict

import numpy as np
import pytest

from storyline.llm.queries import op11_whitening
from storyline.llm.whitening import whitened


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) and abs(c) * 64 < 2.0**62 for c in v)


def brute(rows, most=32, weights="count"):
    """{(id, component): [(n, deviation, |whitened|, explained)]} and the covariance's error, from all rows at once in numpy and Python's whole numbers."""
    by = defaultdict(list)
    for i, v in rows:
        if good(v) and len(v):
            by[len(v)].append((i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)))
    out = defaultdict(list)
    for dim, own in by.items():
        fit = [x for _, x in own] if weights == "count" else sorted({x for _, x in own})
        n, s = len(fit), [sum(x[k] for x in fit) for k in range(dim)]
        centre = lambda x: np.array([(n * a - b) / n for a, b in zip(x, s, strict=True)])  # noqa: E731, B023
        c = np.stack([centre(x) for x in fit])
        v = c.T @ c / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for i, x in own:
            d = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            for k in range(min(most, int((e > 1e-12 * max(e[0], 0)).sum()) if e[0] > 0 else 0)):
                out[i, k + 1].append((n, d, abs(float(centre(x) @ u[:, k]) / math.sqrt(e[k])), e[k] / np.trace(v)))
    return out


def same(df, rows, **more):
    want, got = brute(rows, **more), defaultdict(list)
    for r in df.collect():
        assert r.identity_error <= 1e-4
        got[r.vec_id, r.component].append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert set(got) == set(want)
    for k in want:
        assert len(got[k]) == len(want[k])
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6, abs=1e-6) and a[3] == pytest.approx(b[3], rel=1e-9)
    return got


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    out = op11_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = same(out, rows)
    assert len(got) == 32 * len(rows)


@pytest.mark.parametrize("weights", ["count", "one"])
def test_odd_rows(spark, weights):
    rng = np.random.default_rng(5)
    base = [(k, (rng.standard_normal(6) * [5, 3, 2, 1, 1, 0.5]).tolist()) for k in range(60)]
    hot = [(100 + k, base[0][1]) for k in range(90)]
    short = [(300 + k, rng.standard_normal(3).tolist()) for k in range(20)] + [(330, [1.0, 2.0, 3.0])] * 2
    flat = [(400 + k, [1.0, 1.0]) for k in range(5)] + [(410, [4.0])]
    huge = [(500 + k, [float(2.0**50 * a) for a in rng.standard_normal(4)]) for k in range(12)]
    bad = [(None, base[3][1]), (200, None), (201, [None] + [1.0] * 5), (202, [math.nan] + [1.0] * 5), (203, [math.inf] + [1.0] * 5), (204, []), (205, [1e30] + [1.0] * 5)]
    rows = base + hot + short + flat + huge + bad + base[:2]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, digest string, whitened double").repartition(5)
    got = same(whitened(df, weights=weights), rows, weights=weights)
    assert (None, 1) in got and not any(i in (200, 201, 202, 203, 204, 205, 400, 410) for i, _ in got)
    assert len(got[330, 1]) == 2


def test_large_deviation_is_exact_or_null(spark):
    rows = [(k, [float(2.0**55) * ((k % 5) - 2), float(k)]) for k in range(11)]
    got = {r.vec_id: r.deviation for r in whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: x[0][1] for (i, k), x in brute(rows).items() if k == 1}
    assert all(got[i] == (want[i] if want[i] < 10**38 else None) for i in want) and None in got.values()


def test_few_components_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert {r.component for r in whitened(df, components=3).select("component").distinct().collect()} == {1, 2, 3}
    assert whitened(df.where("false")).count() == 0
    assert whitened(df.limit(1)).count() == 0
