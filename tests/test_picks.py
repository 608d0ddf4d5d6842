"""Headlines of many reports at once against plain walks, report by report."""

import random
from datetime import date, timedelta

import pytest

from storyline.operators import picks

CAND = "day string, article_id long, event long, total int, priority int, trust int, urgency int, seq long, headline_ok boolean, is_vuln boolean, banned boolean, chained boolean, recent boolean, familiar boolean"


def made(seed, days=("a", "b", "c", "d", "e", "f", None), events=6, share=0.5):
    rng = random.Random(seed)
    rows, k = [], 0
    for d in days:
        for _ in range(rng.randint(1, 9)):
            flags = [rng.random() < share for _ in range(6)]
            # Ties in all four points are frequent, so the place in the feed and familiarity decide often.
            rows.append((d, k, rng.randint(1, events), rng.randint(1, 3), 1, rng.randint(1, 2), 1, rng.randint(0, 99) * 1000 + k, *flags))
            k += 1
    pairs = {tuple(sorted(rng.sample(range(1, events + 1), 2))) for _ in range(events // 2)}
    return rows, pairs


def same(x, y, pairs):
    return x == y or tuple(sorted((x, y))) in pairs


def distinct(order, event, pairs, n=3):
    out = []
    for i in order:
        if len(out) < n and all(not same(event[i], event[j], pairs) for j in out):
            out.append(i)
    return out


def tiers(rows, pairs, n=3):
    """The four tiers, one after the other, each over the whole report."""
    event = {r[1]: r[2] for r in rows}
    points = lambda r: (-r[3], -r[4], -r[5], -r[6])
    by_rank = sorted(rows, key=lambda r: (points(r), r[7]))
    eligible = [r for r in by_rank if r[8]]
    free = [r for r in eligible if not r[10]]
    eligible = free if len(free) >= n else eligible
    eligible = sorted(eligible, key=lambda r: (points(r), r[13], r[7]))
    free = [r for r in eligible if not r[11]]
    eligible = free if len(free) >= n else free + [r for r in eligible if r[11]]
    got = distinct([r[1] for r in eligible if not r[12]], event, pairs)
    got = distinct(got + [r[1] for r in eligible if r[1] not in got], event, pairs)
    got = distinct(got + [r[1] for r in by_rank if r[9] and r[1] not in got], event, pairs)
    return got, [r[1] for r in by_rank if r[1] not in got]


@pytest.mark.parametrize("seed, share", [(1, 0.5), (2, 0.3), (3, 0.8)])
def test_tiered_picks_equal_a_walk(spark, seed, share):
    rows, pairs = made(seed, share=share)
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    held = picks.tiered(spark.createDataFrame(rows, CAND).repartition(3), ["day"])
    found = {}
    for r in picks.picked(held, links, ["day"], refill="fill").collect():
        found.setdefault(r.day, {})[r.slot] = r.article_id
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        got, rest = tiers(own, pairs)
        assert [x for _, x in sorted(found[d].items())] == (got + rest)[:3], d


def test_picks_of_repeated_rows_and_empty_tables(spark):
    rows, pairs = made(4)
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    held = picks.tiered(spark.createDataFrame(rows, CAND), ["day"])
    once = sorted(map(repr, picks.picked(held, links, ["day"], refill="fill").collect()))
    assert sorted(map(repr, picks.picked(held.unionByName(held), links, ["day"], refill="fill").collect())) == once
    assert picks.picked(held.limit(0), links, ["day"], refill="fill").count() == 0
    nothing = picks.picked(held, links.limit(0), ["day"])
    assert {r.day for r in nothing.collect()} <= {r[0] for r in rows}


def test_a_hot_report_and_copies(spark):
    """A report with most rows, nearly all of one event: its first, then the others."""
    rows = [("a", k, 1 if k < 2000 else k, 5, 1, 1, 1, k, True, False, False, False, False, False) for k in range(2003)]
    held = picks.tiered(spark.createDataFrame(rows, CAND), ["day"])
    found = picks.picked(held, spark.createDataFrame([(2000, 2001)], "a long, b long"), ["day"]).orderBy("slot").collect()
    assert [(r.slot, r.article_id) for r in found] == [(1, 0), (2, 2000), (3, 2002)]


@pytest.mark.parametrize("seed", [5, 6])
def test_annotated_headlines_equal_a_walk(spark, seed):
    days = ("a", "b", "c", "d", "e", "f")
    rows, pairs = made(seed, days, events=8, share=0.4)
    rng = random.Random(seed + 100)
    ids = [r[1] for r in rows]
    answers = [(d, p, rng.choice(ids) if rng.random() < 0.3 else rng.choice([r[1] for r in rows if r[0] == d])) for d in days[1:] for p in range(5)]
    second = [(d, p, rng.choice([*[r[1] for r in rows if r[0] == d], -1])) for d in days if d != "c" for p in range(6)]
    pool = spark.createDataFrame(rows, CAND).withColumnRenamed("seq", "rank").withColumnRenamed("is_vuln", "has_signal")
    frame = lambda x: spark.createDataFrame(x, "day string, pos int, article_id long")
    found = {}
    for r in picks.annotated_headlines(pool, frame(answers), frame(second), spark.createDataFrame(sorted(pairs), "a long, b long"), ["day"]).collect():
        found.setdefault(r.day, {})[r.slot] = r.article_id
    for d in days:
        own = {r[1]: r for r in rows if r[0] == d}
        order = sorted(own, key=lambda i: own[i][7])
        top = list(dict.fromkeys([i for x, _, i in answers if x == d and i in own][:3])) or order[:3]
        spare = [i for i in order if i not in top and own[i][9]]
        top = [i if own[i][9] or not spare else spare.pop(0) for i in top]
        shown = set(top) | set(order[:12])
        revised = list(dict.fromkeys(i for x, _, i in second if x == d and i in shown))
        top = revised if len(revised) == 3 else top
        line = top + [i for i in order if i not in top]
        free = [i for i in line if not own[i][11]]
        line = free if len(free) >= 3 else free + [i for i in line if own[i][11]]
        want = distinct([i for i in line if not own[i][12]], {i: own[i][2] for i in own}, pairs)
        assert [x for _, x in sorted(found.get(d, {}).items())] == want, d


def test_days_after(spark):
    first = date(2024, 1, 1)
    rows = [("x", first), ("x", first), ("x", first + timedelta(2)), ("y", first), (None, first), ("y", None)]
    held = spark.createDataFrame(rows, "event string, day date")
    one = {(r.event, r.day) for r in picks.days_after(held, "event").collect()}
    assert one == {("x", first + timedelta(k)) for k in range(1, 10)} | {(e, first + timedelta(k)) for k in range(1, 8) for e in ("y", None)}
    two = {(r.event, r.day) for r in picks.days_after(held, "event", least=2).collect()}
    assert two == {("x", first + timedelta(k)) for k in range(3, 8)}
