from collections import defaultdict

import numpy as np
from xxhash import xxh64_intdigest

from storyline.llm import simhash as s


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    base = "one two three four five six seven eight nine ten " * 40
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE "), (None, base), (-3, base + "x"), (905, base + "y z"), (906, "É é"), (907, "é é"), (905, base + "y z")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, fp int, key string")
    assert sorted(map(tuple, s.near_duplicates(df).collect()), key=repr) == sorted(brute(rows), key=repr)
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in brute(rows) if d == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_links_join_all_that_is_within_three_bits(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for c in rng.integers(0, 1 << 63, 12).tolist():  # clusters whose members differ in up to nine bits, many in one block
        for _ in range(150):
            bits = rng.integers(0, 64, 4) if rng.random() < 0.5 else 16 * rng.integers(0, 4) + rng.integers(0, 16, 5)
            x = c
            for b in bits.tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    links = s.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).toPandas()
    a, b = links.a.to_numpy().view(np.uint64), links.b.to_numpy().view(np.uint64)
    assert (np.bitwise_count(a ^ b) <= 3).all()

    def roots(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in pairs:
            root[find(i)] = find(j)
        first = {}
        return [first.setdefault(find(i), i) for i in range(len(fps))]

    every = zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1)), strict=True)
    assert roots(every) == roots(zip(np.searchsorted(fps, a), np.searchsorted(fps, b), strict=True))


def test_a_hot_exact_bucket_finds_three_bits_of_one_block():
    key, rng = 1 << 47, np.random.default_rng(4)
    blocks = np.unique(rng.integers(0, 1 << 16, 300)).astype(np.uint64)
    fp = (blocks << np.uint64(48)) | np.uint64(key)
    got = {frozenset((int(x), int(y))) for a, b in s.bucket_links(key, fp) for x, y in zip(a, b, strict=True)}
    want = {frozenset((int(x), int(y))) for x in fp for y in fp if (int(x) ^ int(y)).bit_count() in (1, 3)}
    assert want <= got
