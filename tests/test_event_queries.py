"""Queries that follow from pairs of events, over a stored table of pairs, against DuckDB or a plain walk."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from storyline.plans import events_plan as ep

from .test_events import walk

MASK = (1 << ep.ARTICLE) - 1


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(12)
    ids = sorted(int(k % 30) << ep.ARTICLE | int(k) for k in range(150))
    kinds, pairs = ["same", "new_development", "same_actor_other_event"], {}
    for _ in range(900):
        a, b = sorted(int(x) for x in rng.choice(ids, 2, replace=False))
        if rng.random() < 0.4:  # of the same or the next days
            near = [i for i in ids if 0 <= (i >> ep.ARTICLE) - (a >> ep.ARTICLE) <= 3 and i > a]
            b = int(rng.choice(near)) if near else b
        pairs[a, b] = (a, b, kinds[rng.integers(0, 3)], [f"name:x{rng.integers(0, 9)}"], float(rng.integers(10, 90)) / 100)
    rows = list(pairs.values())
    own = spark.createDataFrame([(i,) for i in ids], "id long")
    held = spark.createDataFrame(rows, "a long, b long, relation string, shared array<string>, topic double").repartition(3)
    con = duckdb.connect()
    con.register("v", pd.DataFrame({"id": ids}))
    con.register("p0", pd.DataFrame([(a, b, r, s[0], t) for a, b, r, s, t in rows], columns=["a", "b", "relation", "shared", "topic"]))
    con.execute(f"CREATE VIEW p AS SELECT *, a >> {ep.ARTICLE} AS da, b >> {ep.ARTICLE} AS db, a & {MASK} AS xa, b & {MASK} AS xb FROM p0")
    con.execute(f"CREATE VIEW h AS SELECT * FROM p WHERE db > da AND db - da <= {ep.HISTORY}")
    return own, held, con, ids, rows


@pytest.fixture
def given(stored, monkeypatch):
    own, held, con, ids, rows = stored
    monkeypatch.setattr(ep, "fingerprints", lambda *a, **k: own)
    monkeypatch.setattr(ep, "related", lambda views: held)
    return con, ids, rows


_BEST = "SELECT b, CASE min(CASE relation WHEN 'same' THEN 0 WHEN 'new_development' THEN 1 END) WHEN 0 THEN 'same' WHEN 1 THEN 'new_development' END AS relation FROM h WHERE relation <> 'same_actor_other_event' GROUP BY b"
SQL = {
    "strongest_to_history": f"SELECT b & {MASK} AS article_id, relation FROM ({_BEST})",
    "relation_summary": f"""
        WITH t AS (SELECT id >> {ep.ARTICLE} AS day, coalesce(relation, 'none') AS relation, id & {MASK} AS x FROM v LEFT JOIN ({_BEST}) ON b = id)
        SELECT day, relation, count(*) AS n, array_to_string(list(x ORDER BY x)[1:20], ',') AS first FROM t GROUP BY day, relation""",
    "new_across_days": f"SELECT id & {MASK} AS article_id FROM v WHERE id NOT IN (SELECT b FROM h WHERE relation = 'same')",
    "leak_audit": f"SELECT xa AS a, xb AS b, CASE WHEN da = db THEN 'within' ELSE 'across' END AS leak, topic FROM p WHERE relation = 'same' AND db - da <= {ep.HISTORY}",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, given, name):
    result = given[0].execute(SQL[name])
    names = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=repr)
    got = ep.QUERIES[name](spark, "")
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want and want


def test_shadow_clusters(spark, given):
    _, ids, rows = given
    same = {(a, b): s[0] for a, b, r, s, _ in rows if r == "same" and a >> ep.ARTICLE == b >> ep.ARTICLE}
    reps, want = [], set()
    for i in ids:
        told = [r for r in reps if (r, i) in same]
        if told:
            want.add((i & MASK, told[0] & MASK, same[told[0], i]))
        else:
            reps.append(i)
    assert {tuple(r) for r in ep.shadow_clusters(spark, "").select("article_id", "representative", "reason").collect()} == want and want


def test_event_history(spark, given):
    _, ids, rows = given
    old = [i for i in ids if i >> ep.ARTICLE < ep.LAST]
    links = {}
    for a, b, r, _, _ in rows:
        if b >> ep.ARTICLE < ep.LAST:
            links.setdefault(b, {})[a] = r
    events = {}
    for i, e in walk(old, {b: {a: r for a, r in x.items() if r != "same_actor_other_event"} for b, x in links.items()}).items():
        events.setdefault(e, []).append(i)
    want = {}
    for e, own in events.items():
        heads = {i >> ep.ARTICLE for i in own if (i & MASK) % 23 == 0}
        want[e & MASK] = (",".join(sorted({str(i >> ep.ARTICLE) for i in own})), len(heads), max(heads, default=None))
    got = {r.event: (r.days, r.n_headline_days, r.last_headline) for r in ep.event_history(spark, "").collect()}
    assert got == want and any(n for _, n, _ in want.values()) and len(want) < len(old)


def test_stream_ledger(spark, given):
    """The stream of articles gives the ledger of all views."""
    _, ids, _ = given
    want = {r.article_id: r.event for r in ep.event_ledger(spark, "").collect()}
    got = ep.stream_ledger(spark, "/root/testdata/sf0.001").collect()
    assert {r.article_id: r.event for r in got} == want and len(got) == len(ids) > len(set(want.values()))
