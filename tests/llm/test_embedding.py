from collections import defaultdict

import numpy as np
import pytest

from storyline.llm import embedding
from storyline.llm.embedding import near_vectors


def brute(rows, least=0.93):
    """Links, components of (id, vector, label) with exact cosines."""
    good = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = defaultdict(set), {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = defaultdict(list)
    for i, v, y in good:
        v = v / np.abs(v).max()
        groups[y, len(v)].append((i, v / np.linalg.norm(v)))
    for g in groups.values():
        ids, v = [i for i, _ in g], np.stack([v for _, v in g])
        for a, b in zip(*np.nonzero(np.triu(v @ v.T >= least, 1)), strict=True):
            links[ids[a]].add(ids[b])
            links[ids[b]].add(ids[a])
            a, b = sorted((find(ids[a]), find(ids[b])))
            root[b] = a
    return {i: (len(links[i]), find(i) if i is not None else None, i is None or find(i) == i) for i, _, _ in rows}


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for y in (0, 1, 2):
        centres = rng.standard_normal((n // 4, 48))
        for c in centres:
            rows.append((len(rows), c.tolist(), y))
            for _ in range(rng.integers(0, 4)):
                rows.append((len(rows), (c + rng.standard_normal(48) * 0.2).tolist(), y))
    hot = rng.standard_normal(48)
    for _ in range(120):
        rows.append((len(rows), (hot + rng.standard_normal(48) * 0.1).tolist(), 1))
    return rows


@pytest.mark.parametrize("block", [16, 512])
def test_recall_and_no_false_links(spark, block):
    rows = made(3)
    bad = [(None, [1.0] * 48, 1), (9000, None, 1), (9001, [0.0] * 48, 1), (9002, [None] + [1.0] * 47, 1), (9003, [float("nan")] + [1.0] * 47, 1), (9004, [float("inf")] + [1.0] * 47, 1), (9005, rows[0][1], None), (9006, [], 1)]
    same = [(8000 + k, rows[0][1], 0) for k in range(5)] + [(8100, rows[0][1][:40], 0), (8200, [x * 1e-200 for x in rows[0][1]], 0)]
    every = rows + bad + same
    df = spark.createDataFrame([(i, y, v, "n", 1) for i, v, y in every + rows[:9]], "vec_id long, label int, embedding array<double>, key string, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block).collect()}
    want = brute(every)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.98 * sum(x[0] for x in want.values())
    assert np.mean([got[i][1:] == want[i][1:] for i in want]) > 0.97
    assert all(got[i] == want[i] for i, _, _ in bad + same)


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_keys_depend_on_label_and_table():
    p = embedding.Projections(4, 3, 2.0, 1)
    v = np.ones(8) / np.sqrt(8)
    assert len({*p.keys(1, v).tolist(), *p.keys(2, v).tolist()}) == 8
