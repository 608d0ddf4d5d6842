"""Event candidates against all pairs, the ledger against a plain walk, chains against union by shared entities."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from storyline.operators import resolve, stories
from storyline.operators.base import checkpointed
from storyline.plans import events_plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return checkpointed(resolve.without_generic(events_plan.fingerprints(spark, SF, generated=True)))


@pytest.fixture(scope="module")
def every(views):
    a, b = views.select(F.struct("*").alias("y"), F.col("id").alias("a")), views.select(F.struct("*").alias("x"), F.col("id").alias("b"))
    return checkpointed(a.join(b, F.col("a") < F.col("b")).repartition(16))


@pytest.mark.parametrize("cross_day", [False, True])
def test_candidates_have_all_pairs_of_the_same_event(views, every, cross_day):
    found = lambda pairs: {(r.a, r.b, r.rule) for r in resolve.same_event(pairs, cross_day).where("same").select("a", "b", "rule").collect()}
    want = found(every)
    assert found(resolve.paired(resolve.candidate_pairs(views.drop("generic"), cross_day), views)) == want
    assert cross_day or {"title", "topic"} <= {r for _, _, r in want}


def test_candidates_of_runs(views, every):
    """Of days as runs: the pairs of one day that any rule accepts, no more and no fewer."""
    day = lambda c: F.shiftright(c, events_plan.ARTICLE) % 4
    found = lambda pairs: {(r.a, r.b, r.rule) for r in resolve.same_event(pairs).where("same").select("a", "b", "rule").collect()}
    want = found(every.where(day("a") == day("b")))
    assert found(resolve.paired(resolve.candidate_pairs(views.drop("generic"), run=day("id")), views)) == want and len({r for _, _, r in want}) > 1


def test_candidates_have_all_related_pairs(views, every):
    found = lambda pairs: {(r.a, r.b, r.relation, tuple(r.shared)) for r in resolve.relation(pairs).where("relation <> 'unrelated'").select("a", "b", "relation", "shared").collect()}
    want = found(every)
    assert found(resolve.paired(resolve.related_candidates(views.drop("generic")), views)) == want and want


def walk(ids, links, most=3):
    """The ledger as its definition reads."""
    events, out = [], {}
    for v in sorted(ids):
        told = links.get(v, {})
        found = next((e for e in events if any(told.get(r) == "same" for r in e[1])), None) or next((e for e in events if any(r in told for r in e[1])), None)
        if found is None:
            events.append(found := (v, []))
        found[1].insert(0, v)
        del found[1][most:]
        out[v] = found[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ledger_equals_a_walk(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    links = {}
    for _ in range(400):
        a, b = sorted(rng.integers(0, 150, 2).tolist())
        if a < b:
            links.setdefault(b, {})[a] = "same" if rng.random() < 0.5 else "new_development"
    for v in range(200, 260):  # a chain, each of which only the one before is linked to
        links.setdefault(v + 1, {})[v] = "new_development"
    rows = [(a, b, r) for b, x in links.items() for a, r in x.items()]
    relations = spark.createDataFrame(rows, "a long, b long, relation string").unionByName(spark.createDataFrame([(300, 301, "same_actor_other_event")], "a long, b long, relation string"))
    got = stories.event_ledger(spark.range(310), relations)
    assert {r.id: r.event for r in got.collect()} == walk(range(310), links)
    reps = {(r.event, r.pos): r.id for r in stories.event_representatives(got).collect()}
    assert reps[200, 1] == 260 and (200, 4) not in reps


def test_chains_link_by_two_shared_entities(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 5)), f"t{i}", sorted({f"e{x}" for x in rng.zipf(1.6, rng.integers(0, 6)).tolist() if x < 60})) for i in range(120)]
    rows += [(1000 + i, i % 4, "copy", ["p", "q", "e1"]) for i in range(8)] + [(2000, 1, "none", None)]
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in combinations(rows, 2):
        if len(set(x[3] or ()) & set(y[3] or ())) >= 2:
            a, b = sorted((find(x[0]), find(y[0])))
            root[b] = a
    days = {}
    for i, d, _, _ in rows:
        days.setdefault(find(i), set()).add(d)
    got = {r.chain: r.days for r in stories.story_chains(spark.createDataFrame(rows, "id long, day int, title string, entities array<string>")).collect()}
    assert got == {c: sorted(d) for c, d in days.items() if len(d) >= 3}
