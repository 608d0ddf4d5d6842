"""Counting of shared tokens: what searches find, and that frequent tokens aren't counted for rows that can't be similar."""

import numpy as np
from pyspark.sql import functions as F

from storyline.functions import fingerprints as fp
from storyline.operators import grid, resolve
from storyline.plans import events_plan as ep

from .test_decided import every, held, rows_of  # noqa: F401


def chunk(sets):
    tokens = np.array([t for x in sets for t in sorted(x)], np.int64)
    return np.arange(len(sets)), np.zeros(len(sets), np.int64), [grid._coded(np.array([len(x) for x in sets]), tokens)]


def test_likely_rows_are_all_and_few(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [{0, 1, 2, 3, *(int(t) for t in rng.integers(4, 60, rng.integers(0, 8)))} - ({0} if k % 3 else set()) for k in range(200)] + [set()]
    counted, own = [], grid._Shared.counted
    monkeypatch.setattr(grid._Shared, "counted", lambda self, g, low, high: counted.append(int((high - low).sum())) or own(self, g, low, high))
    shared = grid._Shared(chunk(sets), chunk(sets), 0)
    for least in (0.2, 0.42, 0.9):
        for k, x in enumerate(sets):
            shared.k = k
            counted.clear()
            got = set(shared.likely(0, least).tolist())
            assert {j for j, y in enumerate(sets) if x & y and len(x & y) / len(x | y) >= least} <= got
            if least == 0.9 and len(x) > 8:
                assert sum(counted) < 200  # the four that all have aren't counted
            assert set(shared.some(0, 2).tolist()) == {j for j, y in enumerate(sets) if len(x & y) >= 2}
            rows = np.arange(0, len(sets), 1 + k % 70)
            assert shared.of(0, rows).tolist() == [len(x & sets[j]) for j in rows]


def test_relations_of_days(held):  # noqa: F811
    """Pairs so many days apart, found without meeting the others."""
    all_ = resolve.checkpointed(resolve.related_pairs(held))
    for days in ((0, 0), (1, 2), (0, 3)):
        gap = ep.day("b") - ep.day("a")
        want = rows_of(all_.where((gap >= days[0]) & (gap <= days[1])), "relation", "topic")
        assert rows_of(resolve.related_pairs(held, ep.day("id"), days), "relation", "topic") == want and want


def test_repeats_and_names_across_days(held):  # noqa: F811
    same = resolve.checkpointed(resolve.pairs_across(held, ep.day("id"), 3))
    first = F.col("id").bitwiseAND(1) == 0
    for keep, where in (("repeats", "(a & 1) = 0"), ("entity", "rule = 'entity'")):
        assert rows_of(resolve.pairs_across(held, ep.day("id"), 3, keep, first).where("rule = 'entity'" if keep == "entity" else "true"), "rule", "topic") == rows_of(same.where(where), "rule", "topic")


def test_words_and_signs(spark):
    texts = ["", "  one\ttwo \n three", "a b", "pipe npmx xnpm_ İnpm", "Use NPM left-pad now", "die paket name-one", "UNC1234 and CVE-2024-12345, kb1234567 NightEagle", " ".join(f"w{k}" for k in range(90))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("t", fp.first_words(F.col("t"), 60).alias("w"), fp.package_names(F.col("t")).alias("p"), fp.actors(F.col("t")).alias("a"), fp.codenames(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.w == " ".join(r.t.split()[:60])
    assert "left-pad" in got[4].p and "name-one" in got[5].p and got[3].p == []
    assert got[6].a == ["unc1234", "cve202412345"] and got[6].c == ["nighteagle"]
