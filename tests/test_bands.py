"""Searches by bands of sizes, and of a field together with one that is much like it, lose nothing."""

import numpy as np

from storyline.operators import grid


def chunk(*fields):
    n = len(fields[0])
    return np.arange(n), np.zeros(n, np.int64), [grid._coded(np.array([len(x) for x in f]), np.array([t for x in f for t in sorted(x)], np.int64)) for f in fields]


def ratio(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_two_fields_in_one_search(monkeypatch):
    rng = np.random.default_rng(8)
    body, blob = [], []
    for k in range(240):
        x = {int(t) for t in rng.integers(0, 90, int(rng.choice([0, 3, 12, 40, 160])))} if k % 5 or not body else set(body[rng.integers(0, k)])
        body.append(x if k % 9 else set())
        blob.append((x | {int(t) for t in rng.integers(100, 190, int(rng.integers(0, 3)))}) - ({min(x)} if x and k % 7 == 0 else set()))
    for odd in (0, 1):  # without bodies that are empty, searches aren't done apart
        rows = [k for k in range(240) if odd or body[k] or not blob[k]]
        a, b = [body[k] for k in rows], [blob[k] for k in rows]
        both = chunk(a, b, [y - x if x else set() for x, y in zip(a, b, strict=True)])
        shared = grid._Shared(both, both, 0)
        apart, own = [], grid._Shared.likely
        monkeypatch.setattr(grid._Shared, "likely", lambda self, f, least, also=None: apart.append(also is None) or own(self, f, least, also))
        for least in (0.1, 0.22, 0.42, 0.8):
            for k in range(len(rows)):
                shared.k = k
                if a[k] and b[k]:
                    got = set(shared.likely(0, least, (1, 2)).tolist())
                    assert {j for j in range(len(rows)) if max(ratio(a[k], a[j]), ratio(b[k], b[j])) >= least} <= got
        assert not all(apart) and not (any(not x for x in apart) and apart.count(True) == len(apart))
        monkeypatch.setattr(grid._Shared, "likely", own)


def test_rows_of_other_sizes_are_not_counted(monkeypatch):
    sets = [set(range(200)), *[set(range(k, k + 10)) for k in range(50)], set(range(5, 200))]
    both = chunk(sets)
    counted, own = [], grid._Shared.counted
    monkeypatch.setattr(grid._Shared, "counted", lambda self, g, low, high: counted.append(int((high - low).sum())) or own(self, g, low, high))
    shared = grid._Shared(both, both, 0)
    assert shared.likely(0, 0.5).tolist() == [0, 51] and sum(counted) < 400  # 500 more, with the short ones


def test_rows_with_few_tokens_of_the_others():
    x, y = chunk([set(range(100, 120)), set(range(9, 29)), set(range(10))]), chunk([set(range(10)), set(range(5, 15))])
    shared = grid._Shared(x, y, 0)
    for k, want in ((0, set()), (1, {1}), (2, {0, 1})):
        shared.k = k
        assert want <= set(shared.likely(0, 0.25).tolist())
    assert shared.likely(0, 0.9).tolist() == [0]
