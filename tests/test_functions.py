"""Text functions, fingerprints and event rules on hand-written views; selection against walking in order."""

import random

import pytest
from pyspark.sql import functions as F

from storyline.functions import fingerprints as fp
from storyline.functions import text as tx
from storyline.operators import pairs, resolve, stories
from storyline.operators.base import components, first_wins
from storyline.operators.titles import similar_titles


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://WWW.Example.com/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b/?a=1&b=2"),
        ("https://example.com/?ref=z&empty=", "https://example.com"),
        ("https://m.example.com/a/", "https://m.example.com/a"),
        ("no url/", "no url"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, tx.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mon, 02 Jan 2024 03:04:05 +0300", "2024-01-02 00:04:05"),
        ("Mon, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024-01-02T03:04:05.123Z", "2024-01-02 03:04:05.123"),
        ("2024-01-02", "2024-01-02 00:00:00"),
        ("soon", None),
    ],
)
def test_dates(spark, text, want):
    assert one(spark, tx.timestamp_of(F.col("t")).cast("string"), t=text) in (want, (want or "").removesuffix(" 00:00:00") or None)


def test_text_rules(spark):
    assert one(spark, tx.last_full_sentence(F.col("t")), t="One. Two! Three") == "One. Two!"
    assert one(spark, tx.truncated(F.col("t")), t="and then ") and not one(spark, tx.truncated(F.col("t")), t="Done.”")
    assert one(spark, tx.clamped(F.col("t"), 40), t="12.5") == 12 and one(spark, tx.clamped(F.col("t"), 40), t="x") == 0 and one(spark, tx.clamped(F.col("t"), 40), t="99") == 40
    assert tuple(one(spark, tx.corrected_year(F.col("o"), F.col("s")), o="In 2019 it", s="since 2021")) == ("In 2021 it", "replaced")
    assert one(spark, tx.shortened_title(F.col("t"), ["yönelik", "olarak"], 3), t="a yönelik b olarak c") == "a b c"
    assert one(spark, tx.json_value(F.col("t")).cast("string"), t='<think>{"a":2}</think>```json\n{"a": 1}\n```') == '{"a":1}'


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (fp.codenames, "FortiBleed and LONGLEASH hit FortiGate, PhaaS, HTTPS, AAAAAA; CERTFR-2026-AVI-0948", {"fortibleed", "longleash"}),
        (fp.actors, "UNC5792, APT 29 and CVE-2026-12345; Salt Typhoon, Arctic Wolf, Earth Lusca", {"unc5792", "apt29", "cve202612345", "salttyphoon", "earthlusca", "arcticwolf"} - {"arcticwolf"}),
        (fp.keywords, "The attackers attacked APT29 servers, ve için", {"attac", "serve"}),
        (fp.package_names, "The npm package left-pad and @scope/name were hit", {"left-pad", "scope/name", "package", "were"}),
        (fp.title_stems, "Attackers hit Servers", {"attac", "serve"}),
        (fp.bulletin_product, "Multiples vulnérabilités dans Cisco Webex (29 juillet)", {"cisco", "webex"}),
    ],
)
def test_extractors(spark, make, text, want):
    assert set(one(spark, make(F.col("t")), t=text)) == want


def test_entities(spark):
    got = one(spark, fp.entities(F.col("t")), t="Police said Minnesota was hit. Minnesota'daki systems. Hospitals in Coweta")
    assert set(got.certain) == {"minnesot", "coweta"} and set(got.candidate) == {"police", "hospital"}


def test_title_ratio_and_template(spark):
    df = spark.createDataFrame([("Multiples vulnérabilités dans VMware", "Multiples vulnérabilités dans Cisco"), ("Police arrest two", "Police arrest four in a raid")], "a string, b string")
    rows = df.select(fp.title_ratio("a", "b").alias("r"), fp.template_only("a", "b").alias("t")).collect()
    assert rows[0].r > 0.8 and rows[0].t and not rows[1].t


VIEWS = [
    (1, "", "Hackers of SharkLoader hit banks", "Banks", ""),
    (2, "", "SharkLoader campaign grows", "New SharkLoader samples", ""),
    (3, "", "The agency said Minnesota hospitals lost patient records during an outage of their network provider", "Hospitals", ""),
    (4, "", "Records of patient visits at Minnesota hospitals were lost, the agency said, after the network provider failed", "Outage", ""),
    (5, "", "Quarterly results of a chip maker", "Chips", ""),
    (6, "", "Sandworm hit a power grid in one northern region with wiping tools that destroyed control stations overnight", "Grid", ""),
    (7, "", "Sandworm sent phishing mails about invoices to foreign ministries and embassies abroad during spring", "Mails", ""),
]


def test_event_rules(spark):
    views = resolve.without_generic(resolve.fingerprinted(spark.createDataFrame(VIEWS, "id long, out_title string, out_body string, src_title string, src_body string")))
    every = views.select(F.col("id").alias("a")).crossJoin(views.select(F.col("id").alias("b"))).where("a < b")
    decided = {(r.a, r.b): (r.same, r.rule) for r in resolve.same_event(resolve.paired(every, views)).collect()}
    assert decided[3, 4][0] and not decided[3, 5][0] and not decided[6, 7][0]
    cand = {(r.a, r.b) for r in resolve.candidate_pairs(views.drop("generic")).collect()}
    assert {p for p, (s, rule) in decided.items() if s} <= cand
    related = {(r.a, r.b): r.relation for r in resolve.relation(resolve.paired(every, views)).collect()}
    assert related[6, 7] == resolve.ACTOR and related[3, 5] == resolve.UNRELATED and related[1, 2] in (resolve.SAME, resolve.NEW, resolve.UNRELATED)


def test_first_wins_equals_a_walk(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(140)}
    got = {r.id: r.accepted for r in first_wins(spark.range(60), spark.createDataFrame(list(edges), "a long, b long")).collect()}
    taken = []
    for i in range(60):
        if not any((min(i, j), max(i, j)) in edges for j in taken):
            taken.append(i)
    assert {i for i, ok in got.items() if ok} == set(taken)


def test_components_and_chains(spark):
    got = {r.node: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(0, 20) if i != 9], "a long, b long")).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[i] for i in range(10, 21)} == {10}
    nodes = spark.createDataFrame([(1, "d1", "t1", ["a", "b"]), (2, "d2", "t2", ["a", "b", "c", "d"]), (3, "d3", "t3", ["c", "d"]), (4, "d1", "t4", ["x"])], "id long, day string, title string, entities array<string>")
    chain = stories.story_chains(nodes).collect()
    assert [(r.chain, r.days, r.title) for r in chain] == [(1, ["d1", "d2", "d3"], "t1")]


def test_similar_sets_and_titles_miss_nothing(spark):
    rng = random.Random(5)
    sets = [(i, rng.sample("abcdefghijkl", rng.randint(0, 7))) for i in range(80)]
    classes = pairs.set_classes(spark.createDataFrame(sets, "id long, tokens array<string>"))
    got = {(r.a, r.b) for r in pairs.similar_sets(classes, 0.45).collect()}
    reps = {}
    for i, t in sets:
        if t:
            reps.setdefault(frozenset(t), i)
    want = {tuple(sorted((i, j))) for p, i in reps.items() for q, j in reps.items() if i < j and len(p & q) / len(p | q) >= 0.45}
    assert got == want
    from difflib import SequenceMatcher

    titles = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(3, 30)))) for i in range(120)]
    found = {(r.a, r.b) for r in similar_titles(spark.createDataFrame(titles, "id long, title string"), 0.72).collect()}
    first = {}
    for i, t in titles:
        if t.strip():
            first.setdefault(t, i)
    assert found == {(i, j) for p, i in first.items() for q, j in first.items() if i < j and SequenceMatcher(None, q, p).ratio() >= 0.72}


def test_signs_of_packages_in_any_case(spark):
    rows = [(1, "NPM module left-pad", ["left-pad", "module"]), (2, "PİP has foo-bar", ["foo-bar"]), (3, "PYPI: foo-bar", ["foo-bar"]), (4, "xnpmx foo-bar", []), (5, None, []), (6, "", []), (7, "maven " + "x " * 60 + "far-away", [])]
    df = spark.createDataFrame(rows, "id long, t string, want array<string>")
    for r in df.select("id", fp.package_names(F.col("t")).alias("got"), "want").collect():
        assert r.got == r.want, r.id
