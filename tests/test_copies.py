"""Copies of a text on other days: each of them is a view of its own day, whose links its first one doesn't have."""

import pytest
from pyspark.sql import functions as F

from storyline.operators import resolve
from storyline.plans import events_plan as ep

A = "Attackers Hit Contoso\nThe group UNC1234 broke into Contoso and Fabrikam servers on Monday. Then Northwind lost records of many customers in Lisbon."
B = A + " Later the police of Lisbon spoke about it."
HEAD = "Budgets Of Geneva Grow\nA court in Geneva spoke about budgets and taxes. Farmers near Lausanne wait for better days in spring."
#: Ids, whose days are their rest by 30: 40 is a copy of 0 ten days later, 42 tells of it two days after that copy; 70 is a copy of the same day; 48 repeats the headline 46.
TEXTS = {0: A, 40: A, 70: A, 42: B, 46: HEAD, 48: HEAD, 25: "Rain\nRain falls on hills and rivers.", 27: ""}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame([(k, t, "en", "s") for k, t in TEXTS.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    return out


def found(spark, folder, name, *columns):
    return {tuple(r[c] for c in columns) for r in ep.QUERIES[name](spark, folder).collect()}


def test_fingerprints_of_copies(spark, folder):
    """Those of each view by itself."""
    for generated in (False, True):
        own = resolve.fingerprinted(ep.views(spark, folder, generated))
        got = ep.fingerprints(spark, folder, generated, every=True).select(*own.columns)
        told = lambda df: sorted((repr(r) for r in df.collect()))
        assert told(got) == told(own) and got.count() == len(TEXTS)


def test_days_of_copies(spark, folder):
    assert {(40, 42), (40, 70), (42, 70), (46, 48)} <= {tuple(sorted(p)) for p in found(spark, folder, "leak_audit", "a", "b")}
    assert found(spark, folder, "shadow_clusters", "article_id", "representative") == {(70, 40)}
    assert found(spark, folder, "new_across_days", "article_id") == {(0,), (40,), (70,), (46,), (25,), (27,)}
    days = {e: (d, n) for e, d, n in found(spark, folder, "event_history", "event", "days", "n_headline_days")}
    assert days[0] == ("0,10,12", 1) and days[46] == ("16,18", 1)


def test_rules_on_copies(spark, folder):
    assert found(spark, folder, "same_events", "a", "b") == {(40, 70)}
    assert found(spark, folder, "repeat_links", "day", "n_links") == {(10, 2), (12, 2), (16, 1), (18, 1)}
    assert found(spark, folder, "headline_repeats", "article_id") == {(48,)}
    assert found(spark, folder, "repeat_scan", "day", "kind", "n") == {(12, "caught", 2), (18, "caught", 1)}


def test_names_and_misses_of_copies(spark, folder, monkeypatch):
    """Without an actor, names bring copies of other days together; what is told the same is no miss."""
    text = A.replace("UNC1234", "of thieves")
    rows = [(0, text), (40, text), (42, text + " Nobody else was hurt."), (44, "Spring\nIt was said that Contoso and others plant trees along roads in summer.")]
    views = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(ep, "articles", lambda *_: views.select(F.col("doc_id").alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("src_body"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day")))
    monkeypatch.setattr(ep, "_headline", lambda c="id": F.lit(True))
    assert found(spark, folder, "entity_matches", "a", "b") == {(40, 42)}
    assert {(40, 44), (42, 44)} == found(spark, folder, "near_misses", "a", "b")
