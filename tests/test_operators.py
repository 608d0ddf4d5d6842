"""Ranking, report, selection and ledger operators on small tables."""

from pyspark.sql import functions as F

from storyline.functions import predicates as pr
from storyline.operators import ranking, report, select, stories
from storyline.operators.runfilter import run_filter
from storyline.sources import sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_raw_scores_are_typed_and_clamped(spark):
    rows = [(1, "nation_state_apt", "evet", "0", "99", "x", "7.5", None), (2, "unknown", "1", None, "10", "10", "10", "10"), (3, "veri_ihlali", "no", "1", "10", "10", "10", "10")]
    got = {r.article_id: r for r in ranking.scored(frame(spark, rows, "article_id int, category string, cyber_gate string, dup_flag string, strategic string, impact string, urgency string, trust string")).collect()}
    assert (got[1].total, got[1].strategic, got[1].urgency) == (48, 40, 8)
    assert got[2].category == "siber_disi" and got[2].total == 0 and got[3].total == 0 and got[3].dup_flag


def test_answers_are_accepted_once_and_for_their_batch(spark):
    asked = frame(spark, [(0, 1), (0, 2), (1, 3)], "batch int, article_id int")
    answers = frame(spark, [(0, 1, 0, "a"), (0, 1, 1, "b"), (1, 2, 0, "c"), (1, 3, 0, "d")], "batch int, article_id int, pos int, value string")
    first, again = ranking.accepted_answers(asked, answers)
    assert sorted((r.article_id, r.value) for r in first.collect()) == [(1, "a"), (3, "d")] and [r.article_id for r in again.collect()] == [2]


def test_replacement_takes_the_first_that_fits(spark):
    cand = frame(spark, [("d", 1, 1), ("d", 2, 2), ("d", 3, 3)], "day string, article_id int, rank int")
    got = ranking.replacement(cand, frame(spark, [("d", 1), ("d", 9)], "day string, article_id int"), frame(spark, [(2, 9)], "article_id int, other int"), ["day"]).collect()
    assert [r.article_id for r in got] == [3]


def test_violations_and_decisions(spark):
    rows = [("d", 1, "headline", 1, 1, None, True), ("d", 1, "body", 2, 1, None, True), ("d", 1, "body", 3, 2, None, True), ("d", 1, "body", 3, 4, None, True), ("d", 2, "headline", 2, 1, None, False), ("d", 2, "dropped", 3, 1, "dup", True)]
    layers = frame(spark, rows, "day string, layer_no int, section string, article_id int, pos int, reason string, headline_ok boolean")
    got = {(r.kind, r.article_id) for r in report.violations(layers, frame(spark, [("d", 2)], "day string, article_id int"), ["day"]).collect()}
    assert got == {("repeated", 3), ("unexplained", 1), ("banned", 2), ("category", 2)}
    assert {r.article_id: r.section for r in report.decisions(layers, ["day"]).collect()} == {1: "headline", 2: "headline", 3: "dropped"}


def test_overrides_are_renumbered(spark):
    own = frame(spark, [("d", "body", i, i) for i in (1, 2, 3)], "day string, section string, article_id int, pos int")
    ops = frame(spark, [("d", "delete", "body", 2, None, None), ("d", "replace", "body", 3, None, 7), ("d", "add", "body", 8, 1, None)], "day string, op string, section string, article_id int, pos int, by_id int")
    got = report.overridden(own, ops).orderBy("pos").collect()
    assert [(r.pos, r.article_id) for r in got] == [(1, 8), (2, 1), (3, 7)]


def test_swaps_need_three_valid_ids(spark):
    picks, valid = frame(spark, [(1, 1), (2, 2), (3, 3)], "id int, pos int"), spark.range(9).select(F.col("id").cast("int"))
    ids = lambda rows: sorted(r.id for r in select.swaps(picks, frame(spark, rows, "id int, pos int"), valid).collect())
    assert ids([(4, 1), (5, 2), (6, 3)]) == [4, 5, 6] and ids([(4, 1), (5, 2), (99, 3)]) == [1, 2, 3] and ids([(4, 1), (4, 2), (5, 3)]) == [1, 2, 3]


def test_ledger_keeps_the_newest_representatives(spark):
    views = spark.range(1, 8)
    rel = frame(spark, [(1, 2, "same"), (2, 3, "new_development"), (3, 4, "same"), (1, 5, "same"), (4, 5, "new_development"), (6, 7, "unrelated")], "a long, b long, relation string")
    got = {r.id: r.event for r in stories.event_ledger(views, rel).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    days = stories.event_days(frame(spark, [(1, "2024-01-01", True), (1, "2024-01-02", True), (1, "2024-01-02", False), (2, "2024-01-01", False)], "event int, day string, is_headline boolean")).orderBy("event").collect()
    assert [(r.n_headline_days, r.last_headline) for r in days] == [(2, "2024-01-02"), (0, None)]


def test_state_rules(spark):
    day = F.lit("2024-01-10").cast("date")
    rows = spark.createDataFrame([("2024-01-01", "a", "t"), ("2024-01-05", "b", "t")], "day string, link string, title string").withColumn("day", F.col("day").cast("date"))
    pending = spark.createDataFrame([("2024-01-10", " c  d ", "x\ty"), ("2024-01-09", "stale", "t"), ("2024-01-10", None, "t")], "day string, link string, title string").withColumn("day", F.col("day").cast("date"))
    assert sorted(r.link for r in sinks.appended_ledger(rows, pending, day, True).collect()) == ["b", "c d"]
    assert sorted(r.link for r in sinks.appended_ledger(rows, pending, day, False).collect()) == ["b"]
    kept = spark.range(1).select(sinks.kept_report(F.lit(True), F.lit(9), F.lit(5)).alias("a"), sinks.kept_report(F.lit(False), F.lit(9), F.lit(5)).alias("b")).first()
    assert not kept.a and kept.b


def test_predicates(spark):
    terms = {"terms": ["devlet destekli"], "countries": ["Rusya", "Iran"], "links": ["bağlantılı"], "actors": ["casus"]}
    rows = [("Rusya ile bağlantılı grup",), ("casus yazılımı Iran için",), ("Rusya " + "x" * 80 + " bağlantılı",), ("Devlet Destekli ekip",), (None,)]
    got = [r.x for r in frame(spark, rows, "t string").select(pr.attributed(F.col("t"), **terms).alias("x")).collect()]
    assert got == [True, True, False, True, False]
    social = frame(spark, [("<b>Hi</b> see https://x.y/z #tag all",)], "t string").select(pr.social_text(F.col("t")).alias("x")).first().x
    assert social == "Hi see all"
    page = frame(spark, [("a **b** <style>p**q</style> ```html c",)], "t string").select(pr.without_markup(F.col("t")).alias("x")).first().x
    assert page == "a b <style>p**q</style>  c"


def test_run_filter_equals_a_walk(spark):
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(8)
    names = ["Ransomware hits hospital chain in Ohio", "Hospital chain in Ohio hit by ransomware", "LONGLEASH malware found", "New wave of LONGLEASH attacks", "Router flaw patched", "Quarterly chip results rise", "Router flaw patched again", "Router flaw CVE-2026-1111 is patched", "Patched is Router flaw CVE-2026-2222"]
    rows = [(i, rng.choice(["", None, "u1", "u2", f"v{i}"]), f"h{rng.randint(0, 25)}", rng.choice(names) + rng.choice(["", " today", " v2"]), i < 8) for i in range(40)]
    got = {r.id: (r.accepted, r.level) for r in run_filter(frame(spark, rows, "id long, url string, content_hash string, title string, in_history boolean")).collect()}
    stems = lambda t: {w[:5] for w in t.lower().split() if len(w) >= 5}

    def template(x, y):
        n = next((k for k, (a, b) in enumerate(zip(x.lower(), y.lower(), strict=False)) if a != b), min(len(x), len(y)))
        if n < 15 or any(w[:1].isupper() or any(c.isdigit() for c in w) for w in x[:n].split()[1:]):
            return False
        p, q = x.lower()[n:].strip(), y.lower()[n:].strip()
        if not p or not q:
            return False
        m = next((k for k, (a, b) in enumerate(zip(p[::-1], q[::-1], strict=False)) if a != b), min(len(p), len(q)))
        p2, q2 = p[: len(p) - m].strip(), q[: len(q) - m].strip()
        p, q = (p2, q2) if p2 and q2 else (p, q)
        return SequenceMatcher(None, p, q).ratio() < 0.5

    def level(new, old):
        _, u, h, t, _ = new
        _, v, g, s, past = old
        if u and u == v:
            return 1
        if h == g and t.lower() == s.lower():
            return 2
        veto = template(t, s)
        if SequenceMatcher(None, t.lower(), s.lower()).ratio() >= 0.72 and not veto:
            return 3
        ids = lambda x: set(re.findall(r"cve-\d{4}-\d+", x.lower()))
        if ids(t) and ids(s) and ids(t) != ids(s):
            veto = True
        if len(stems(t) & stems(s)) / max(1, len(stems(t) | stems(s))) >= 0.45 and not veto:
            return 4
        return 5 if not past and "LONGLEASH" in t and "LONGLEASH" in s else None

    taken = [r for r in rows if r[4]]
    for r in rows[8:]:
        levels = [x for x in (level(r, o) for o in taken) if x]
        assert got[r[0]] == (not levels, min(levels, default=None)), r
        if not levels:
            taken.append(r)


def test_runs_of_the_filter_are_isolated(spark):
    """Runs settled together give what each gives by itself, a run without a key included."""
    import random

    rng = random.Random(21)
    names = ["Ransomware hits hospital chain in Ohio", "Hospital chain in Ohio hit by ransomware", "LONGLEASH malware found", "New wave of LONGLEASH attacks", "Router flaw patched today", "Router flaw patched", ""]
    rows = [(i, rng.choice(["", None, "u1", f"v{i}"]), f"h{rng.randint(0, 9)}", rng.choice([*names, None]), i < 15, rng.choice(["a", "b", None])) for i in range(60)]
    items = frame(spark, rows, "id long, url string, content_hash string, title string, in_history boolean, source string")
    value = lambda df: {r.id: (r.accepted, r.level) for r in df.collect()}
    alone = {}
    for k in ("a", "b", None):
        alone |= value(run_filter(items.where(F.col("source").eqNullSafe(F.lit(k)))))
    together = value(run_filter(items, ("source",)))
    assert together == alone
    assert len(together) == 45 and together != value(run_filter(items))
    assert run_filter(items.limit(0), ("source",)).count() == 0
