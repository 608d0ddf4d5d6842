"""Matches of chains, ledgers and headlines, swaps and replacements against plain walks; queries across days against all pairs of views."""

import random

import pytest
from pyspark.sql import functions as F

from storyline.functions import lexicon as lx
from storyline.operators import headline, resolve, stories
from storyline.plans import events_plan as ep

SF = "/root/testdata/sf0.001"
MASK = (1 << ep.ARTICLE) - 1


def test_matching_chain(spark):
    rng = random.Random(3)
    names = [f"e{k}" for k in range(25)]
    items = [(k, rng.sample(names, rng.randint(0, 4))) for k in range(60)]
    chains = [(100 + k, rng.sample(names[:18], rng.randint(1, 4))) for k in range(20)]
    got = {r.id: r.chain for r in stories.matching_chain(spark.createDataFrame(items, "id int, entities array<string>"), spark.createDataFrame(chains, "chain int, entities array<string>")).collect()}
    want = {i: next((c for c, held in chains if set(held) & set(e)), None) for i, e in items}
    assert got == {i: c for i, c in want.items() if c} and len(got) < 60


def test_ledger_and_headline_matches(spark):
    rng = random.Random(4)
    ledger = [(i, rng.choice([0, 1, 2, 3, 7])) for i in range(40)]
    reps = {}
    for i, e in sorted(ledger, reverse=True):
        reps.setdefault(e, []).append(i)
    reps = {e: x[:3] for e, x in reps.items()}
    new = range(100, 130)
    rel = {(a, b): rng.choice(["same", "new_development", "same_actor_other_event"]) for b in new[:20] for a in rng.sample(range(40), 4)}
    loose = {(a, b) for b in new for a in rng.sample(range(40), 2)}
    heads = {1, 3, 7}
    table = spark.createDataFrame(ledger, "id long, event long")
    held = stories.event_representatives(table)
    assert {(r.event, r.pos): r.id for r in held.collect()} == {(e, k): i for e, x in reps.items() for k, i in enumerate(x, 1)}
    relations = spark.createDataFrame([(a, b, r) for (a, b), r in rel.items()], "a long, b long, relation string")

    def match(b):
        """The first event with a representative that tells the same, else the first that is developed."""
        for want in ("same", "new_development"):
            for e in sorted(reps):
                if any(rel.get((i, b)) == want for i in reps[e]):
                    return e, want
        return None

    strict = {b: match(b) for b in new if match(b)}
    assert {r.id: (r.event, r.relation) for r in stories.ledger_match(relations, held).collect()} == strict
    near = {b: next((e for e in sorted(heads) if any((i, b) in loose for i in reps.get(e, []))), None) for b in new}
    want = {b: strict[b][0] if b in strict else near[b] for b in new if b in strict or near[b] is not None}
    got = stories.headline_match(relations, spark.createDataFrame(sorted(loose), "a long, b long"), held, spark.createDataFrame([(e,) for e in heads], "event long"))
    assert {r.id: r.event for r in got.collect()} == want and len(want) > len(strict) > 0


def test_editor_swaps(spark):
    rng = random.Random(5)
    proposed, head, body, banned, want = [], [], [], [], {}
    for d in range(12):
        rows = {i: (rng.randint(1, 5), rng.randint(1, 3), rng.random() < 0.8) for i in range(d * 100, d * 100 + 9)}
        ids = list(rows)
        place = {i: "headline" if k < 3 else "body" for k, i in enumerate(ids)}
        no = set(rng.sample(ids, 2))
        head += [(d, i, *rows[i]) for i in ids[:3]]
        body += [(d, i, *rows[i]) for i in ids[3:]]
        banned += [(d, i) for i in no] * 2
        done = 0
        for pos in range(6):
            down, up = rng.choice([*ids[:4], -1]), rng.choice([*ids[2:], -2])
            proposed.append((d, pos, down, up))
            if done >= 2 or place.get(down) != "headline" or place.get(up) != "body":
                action = "void"
            elif up in no:
                action = "banned"
            elif not rows[up][2]:
                action = "category"
            elif rows[up][0] < rows[down][0] and rows[up][1] < rows[down][1]:
                action = "weaker"
            else:
                action, done = "done", done + 1
                place[down], place[up] = "body", "headline"
            want[d, pos] = (down, up, action)
    told = lambda x: spark.createDataFrame(x, "day int, article_id long, total int, priority int, headline_ok boolean")
    got = headline.editor_swaps(spark.createDataFrame(proposed, "day int, pos int, down long, up long").repartition(3), told(head), told(body), spark.createDataFrame(banned, "day int, article_id long"), ["day"])
    assert {(r.day, r.pos): (r.down, r.up, r.action) for r in got.collect()} == want
    assert {a for _, _, a in want.values()} == {"void", "banned", "category", "weaker", "done"}


def test_replaced_within(spark):
    rng = random.Random(6)
    picks, pool, want, pairs = [], [], {}, set()
    for d in range(10):
        ids = list(range(d * 100, d * 100 + 8))
        own = {tuple(sorted(rng.sample(ids, 2))) for _ in range(9)}
        pairs |= own
        same = lambda x, y: tuple(sorted((x, y))) in own  # noqa: B023, E731
        picks += [(d, k + 1, i) for k, i in enumerate(ids[:3])]
        pool += [(d, k + 1, i) for k, i in enumerate(ids)]
        kept = [ids[0]]
        for i in ids[1:3]:
            if any(same(i, j) for j in kept):
                i = next((x for x in ids[3:] if x not in kept and not any(same(x, j) for j in kept)), i)
            kept.append(i)
        want[d] = kept
    links = spark.createDataFrame([x for p in pairs for x in (p, p[::-1])], "article_id long, other long")
    got = headline.replaced_within(spark.createDataFrame(picks, "day int, slot int, article_id long"), spark.createDataFrame(pool, "day int, rank int, article_id long"), links, ["day"])
    found = {}
    for r in got.orderBy("slot").collect():
        found.setdefault(r.day, []).append(r.article_id)
    assert found == want and any(x[1:] != [d * 100 + 1, d * 100 + 2] for d, x in want.items())


@pytest.fixture(scope="module")
def decided(spark):
    """Every two views of sf0.001 at most a week apart, by the rules across days, without any search for candidates."""
    own = resolve.checkpointed(ep.fingerprints(spark, SF, generated=True))
    a, b = own.select(F.col("id").alias("a")), own.select(F.col("id").alias("b"))
    every = a.crossJoin(b).where((ep.day("b") > ep.day("a")) & (ep.day("b") - ep.day("a") <= ep.HISTORY))
    return own, resolve.checkpointed(resolve.same_event(resolve.paired(every, own), cross_day=True))


@pytest.fixture
def stored(decided, monkeypatch):
    monkeypatch.setattr(ep, "fingerprints", lambda *a, **k: decided[0])
    return decided[1]


def pairs_of(df, *more):
    return sorted(tuple(r[c] for c in ("a", "b", *more)) for r in df.collect())


def test_entity_matches(spark, stored):
    want = pairs_of(stored.where("rule = 'entity'").select(ep.article("a"), ep.article("b")))
    assert pairs_of(ep.entity_matches(spark, SF)) == want


def test_headline_repeats(spark, stored):
    want = {r.b & MASK for r in stored.where("same").select("a", "b").collect() if (r.a & MASK) % 23 == 0}
    got = [r.article_id for r in ep.headline_repeats(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_near_misses(spark, stored, monkeypatch):
    """With every article a headline, as those of so small a table meet nothing."""
    monkeypatch.setattr(ep, "_headline", lambda c="id": F.lit(True))
    want = pairs_of(resolve.near_misses(stored).select(ep.article("a"), ep.article("b"), F.array_join("shared", ",").alias("shared")), "shared")
    assert pairs_of(ep.near_misses(spark, SF), "shared") == want and want


def test_repeat_links(spark, stored):
    want = {}
    for r in stored.where("same").select("a", "b").collect():
        for d in (r.a >> ep.ARTICLE, r.b >> ep.ARTICLE):
            want[d] = want.get(d, 0) + 1
    assert {r.day: r.n_links for r in ep.repeat_links(spark, SF).collect()} == want and want


@pytest.mark.parametrize("least_days", [3, 2])
def test_repeat_scan(spark, stored, monkeypatch, least_days):
    """Chains of two days as well, as so small a table has few of three."""
    own = stories.story_chains
    monkeypatch.setattr(stories, "story_chains", lambda nodes: own(nodes, least_days=least_days))
    hit = F.arrays_overlap("x.actors", "y.actors") | F.arrays_overlap("x.codes", "y.codes") | F.arrays_overlap("x.packages", "y.packages") | (F.size(ep.fp.shared_entities(F.col("x.names"), F.col("y.names"))) > 0)
    rows = stored.select("a", "b", "same", "topic", F.coalesce(hit, F.lit(False)).alias("hit")).collect()
    nodes = ep._stories(spark, SF)
    names = {n for r in stories.story_chains(nodes).collect() for n in r.entities}
    told = {r.id for r in nodes.collect() if names & set(r.entities)}
    want = {}
    for r in rows:
        ongoing = r.a & MASK in told and r.b & MASK in told
        kind = "caught" if r.same else ("ongoing story" if ongoing else "suspicious") if r.topic >= lx.SUSPICIOUS_TOPIC and not r.hit else None
        if kind:
            want[r.b >> ep.ARTICLE, kind] = want.get((r.b >> ep.ARTICLE, kind), 0) + 1
    assert {(r.day, r.kind): r.n for r in ep.repeat_scan(spark, SF).collect()} == want and want
