"""Pairs that are decided where views meet, against the rules over all pairs; and rows of sets, which are stored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.operators import grid, resolve
from storyline.plans import events_plan as ep

TEXTS = [
    "Attackers Hit Contoso With NightEagle\nThe group UNC1234 broke into Contoso and Fabrikam servers. Then Northwind lost records of CVE-2024-1111.",
    "Contoso Is Hit Again\nThe group UNC1234 broke into Contoso and Fabrikam servers. Later Tailspin and Woodgrove and Litware lost records too.",
    "Weather Of The Week\nRain falls on hills and rivers while farmers wait for better days in spring.",
    "Weather Of That Week\nRain falls on hills and rivers while farmers wait for better days in autumn.",
    "UNC1234 In Other News\nA court in Geneva spoke about budgets. Taxes rise.",
    "NightEagle Returns\nNothing else is known. Banks in Lisbon closed early.",
    "",
]


@pytest.fixture(scope="module")
def held(spark):
    rows = [((k % 5) << ep.ARTICLE | k, "", TEXTS[k % 7].split("\n")[0] + " " * (k // 7), TEXTS[k % 7] + f" Told {k}.") for k in range(21)]
    views = spark.createDataFrame([(i, "", b, t, b) for i, _, t, b in rows], "id long, out_title string, out_body string, src_title string, src_body string")
    return resolve.checkpointed(resolve.without_generic(resolve.fingerprinted(views)))


@pytest.fixture(scope="module")
def every(held):
    a, b = held.select(F.struct("*").alias("y"), F.col("id").alias("a")), held.select(F.struct("*").alias("x"), F.col("id").alias("b"))
    return resolve.checkpointed(a.join(b, F.col("a") < F.col("b")))


def rows_of(df, *names):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select("a", "b", *names).collect())


def test_related_pairs(held, every):
    want = rows_of(resolve.relation(every).where("relation <> 'unrelated'"), "relation", "topic", "shared")
    assert rows_of(resolve.with_shared(resolve.related_pairs(held), held), "relation", "topic", "shared") == want
    assert {r[2] for r in want} == set(resolve.RELATIONS)


def test_pairs_across(held, every):
    decided = resolve.same_event(every.where((ep.day("b") > ep.day("a")) & (ep.day("b") - ep.day("a") <= 3)), cross_day=True)
    want = rows_of(decided.where("same"), "rule", "topic")
    assert rows_of(resolve.pairs_across(held, ep.day("id"), 3), "rule", "topic") == want and len({r[2] for r in want}) > 1
    misses = resolve.pairs_across(held, ep.day("id"), 3, "misses", F.lit(True))
    assert rows_of(resolve.with_shared_signals(misses.select("a", "b"), held), "shared") == rows_of(resolve.near_misses(decided), "shared")


def test_a_row_is_stored_once(spark, monkeypatch):
    """Whatever the number of groups; before, each of them got a copy of it."""
    monkeypatch.setattr(grid, "ALONE", 0)
    sent, own = [], grid.checkpointed

    def seen(df):
        out = own(df)
        sent.append(sum(len(grid._read(bytes(r.chunk))[0]) for r in out.collect()))
        return out

    monkeypatch.setattr(grid, "checkpointed", seen)
    rows = spark.range(300).select("id", (F.col("id") % 10).alias("flags"), F.array(F.col("id") % 7, F.col("id") % 11 + 100).alias("x"))
    decide = lambda shared, n, m, p, q, later: ((shared(0) == 2) & (np.abs(q - p) <= 1), shared(0))
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (b - a) % 77 == 0 and abs(a % 10 - b % 10) <= 1}
    for reach in (None, 1):
        got = [(r.a, r.b) for r in grid.pairs_of_sets(rows, ["x"], decide, reach).collect()]
        assert sorted(got) == sorted(want) and want
    assert sent == [300, 300]
