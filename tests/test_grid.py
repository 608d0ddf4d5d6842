"""Pairs of sets found in tasks, over several groups, against all pairs."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from storyline.operators import grid, pairs


def test_groups_find_all_pairs_once_and_write_no_others(spark, monkeypatch):
    monkeypatch.setattr(grid, "ALONE", 0)
    monkeypatch.setattr(grid, "GROUPS", 3)
    rng = np.random.default_rng(5)
    sets = {int(k) * 7: {f"t{x}" for x in rng.choice(25, rng.integers(1, 9), replace=False)} for k in range(160)}
    kinds = {k: 1 + k % 3 for k in sets}
    rows = spark.createDataFrame([(k, k, sorted(v), kinds[k]) for k, v in sets.items()], "id long, rep long, tokens array<string>, kinds int").repartition(5)
    ratio = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for least, name in ((0.45, None), (0.2, "kinds")):
        got = pairs.similar_sets(rows, least, name)
        want = {(a, b, ratio(a, b)) for a, b in combinations(sorted(sets), 2) if ratio(a, b) >= least and (name is None or kinds[a] & kinds[b])}
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # pairs that only share a token aren't rows


def test_no_sets_no_pairs(spark):
    none = spark.createDataFrame([], "id long, rep long, tokens array<string>")
    assert pairs.similar_sets(none, 0.5).isEmpty()
    assert grid.pairs_of_sets(none.select("id", F.lit(1).alias("flags"), F.lit(None).cast("array<bigint>").alias("x")), ["x"], lambda *_: None).isEmpty()
