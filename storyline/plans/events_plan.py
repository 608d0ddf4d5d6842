"""Queries on events: which articles tell of the same one, how they are related, and what follows for reports. Ids are in the order of days."""

from __future__ import annotations

from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import lexicon as lx
from ..operators import report as rp
from ..operators import resolve, select, stories
from ..operators.base import checkpointed, shared_dir, stored
from ..streaming import stream
from .tables import ARTICLES, articles, joined, streamed

#: Bits of an ordered id that name the article; those above count days.
ARTICLE = 40


def article(c: str):
    return F.col(c).bitwiseAND(F.lit((1 << ARTICLE) - 1)).alias(c)


def day(c: str):
    return F.shiftright(c, ARTICLE)


def views(spark: SparkSession, sf_dir: str, generated: bool = False) -> DataFrame:
    """Articles as views of their sources, in the order of days; with ``generated`` an article's text also stands for the generated one.

    Without it, as before a report is written, rules look at titles and at what of a source they ever look at, its first BODY_CHARS characters.
    """
    own = articles(spark, sf_dir)
    ordered = F.shiftleft(F.date_diff("day", F.lit("2024-01-01").cast("date")).cast("long"), ARTICLE).bitwiseOR(F.col("article_id"))
    body = F.col("src_body") if generated else F.lit("")
    return own.select(ordered.alias("id"), F.lit("").alias("out_title"), body.alias("out_body"), F.col("title").alias("src_title"), "src_body")


def fingerprints(spark: SparkSession, sf_dir: str, generated: bool = False, every: bool = False) -> DataFrame:
    """One view of each class of equal ones; ``view_classes`` has the members. With ``every``, all members: copies of other days meet what their first one doesn't."""
    classes = resolve.view_classes(views(spark, sf_dir, generated))
    own = resolve.fingerprinted(classes.where("id = rep"))
    return resolve.of_members(own, classes) if every else own


def view_classes(spark, sf_dir):
    return resolve.view_classes(views(spark, sf_dir)).select(article("id").alias("article_id"), article("rep").alias("representative"))


def _decided(own: DataFrame, run=None) -> DataFrame:
    found = resolve.same_event(resolve.paired(resolve.candidate_pairs(own, run=run), own))
    return found.where("same").select(article("a"), article("b"), "rule", F.round("topic", 6).alias("topic"))


def same_events(spark, sf_dir):
    """Pairs of a day's articles that tell of the same event, by the whole cascade of rules: the article's whole text stands for the generated one.

    Each day is a run, as these rules are for the articles of one; ``entity_matches`` and ``repeat_scan`` have the rules across days.
    """
    return _decided(fingerprints(spark, sf_dir, generated=True, every=True), day("id"))


def same_source_events(spark, sf_dir):
    """Pairs of all articles, as before a report is written: no generated text, so neither names nor the topics of bodies count."""
    return _decided(fingerprints(spark, sf_dir))


class Apart(NamedTuple):
    """Views of which only pairs that are from ``least`` to ``most`` days apart are asked for."""

    views: DataFrame
    least: int
    most: int


def related(own: DataFrame | Apart) -> DataFrame:
    """Pairs of fingerprinted views that are related, with their relation. ``_shared`` has what they share."""
    if isinstance(own, Apart):
        return resolve.related_pairs(resolve.without_generic(own.views), day("id"), (own.least, own.most))
    return resolve.related_pairs(resolve.without_generic(own))


def _shared(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """``pairs`` with what they share, where it isn't known yet."""
    return pairs if "shared" in pairs.columns else resolve.with_shared(pairs, resolve.without_generic(own))


def event_relations(spark, sf_dir):
    own = fingerprints(spark, sf_dir)
    return _shared(related(own), own).select(article("a"), article("b"), "relation", joined(F.col("shared")).alias("shared"), F.round("topic", 6).alias("topic"))


def event_ledger(spark, sf_dir):
    own = fingerprints(spark, sf_dir)
    return stories.event_ledger(own.select("id"), related(own).select("a", "b", "relation")).select(article("id").alias("article_id"), article("event").alias("event"))


def stream_ledger(spark, sf_dir):
    """The ledger of events kept by a stream of articles, of equal ones the first: each micro-batch against itself and three views of each event before it."""
    own = fingerprints(spark, sf_dir)
    pairs, ids = stored(related(own).select("a", "b", "relation")), own.select("id")
    docs = streamed(spark, sf_dir, "documents")
    ordered = F.shiftleft((F.col("doc_id") % 30).cast("long"), ARTICLE).bitwiseOR(F.col("doc_id")).alias("id")

    def relate(batch: DataFrame, known: DataFrame) -> DataFrame:
        old = batch.select("id").unionByName(known.select("id")).distinct()
        return pairs.join(batch.select(F.col("id").alias("b")), "b", "left_semi").join(old.select(F.col("id").alias("a")), "a", "left_semi")

    found = stream.ledgered(docs.select(ordered).join(ids, "id", "left_semi"), relate, f"{shared_dir(spark)}/ledger-{uuid4().hex}")
    return found.select(article("id").alias("article_id"), article("event").alias("event"))


def story_chains(spark, sf_dir):
    """Chains of articles that share two names of their stories and more, on three days and more."""
    found = stories.story_chains(_stories(spark, sf_dir))
    return found.select("chain", F.size("days").cast("long").alias("n_days"), "n_nodes", F.size("entities").cast("long").alias("n_entities"), "title")


#: The last day, whose articles are a run's where there is one run, and how many days before are a run's history.
LAST, HISTORY = 29, 7


def _history(spark, sf_dir):
    """Related pairs of views, b, with those of the week before, a: each day is a run."""
    own = fingerprints(spark, sf_dir, every=True)
    return own, related(Apart(own, 1, HISTORY)).where((day("b") > day("a")) & (day("b") - day("a") <= HISTORY))


def strongest_to_history(spark, sf_dir):
    """Of each article that is related to the week before, the strongest relation."""
    return select.strongest(_history(spark, sf_dir)[1]).select(article("id").alias("article_id"), "relation")


def relation_summary(spark, sf_dir):
    """By day, how many articles have which strongest relation to the week before, and the first of them."""
    own, pairs = _history(spark, sf_dir)
    relation = F.coalesce("relation", F.lit("none")).alias("relation")
    told = own.select("id").join(select.strongest(pairs), "id", "left").select(day("id").cast("long").alias("day"), relation, article("id").alias("article_id"))
    return rp.grouped_ids(told, ["day"], "relation").select("day", "relation", "n", F.array_join("first", ",").alias("first"))


def new_across_days(spark, sf_dir):
    """Articles that tell nothing that the week before tells the same."""
    own, pairs = _history(spark, sf_dir)
    return own.select("id").join(pairs.where("relation = 'same'").select(F.col("b").alias("id")), "id", "left_anti").select(article("id").alias("article_id"))


def leak_audit(spark, sf_dir):
    """Pairs that tell the same within a day, or within a week."""
    pairs = related(Apart(fingerprints(spark, sf_dir, every=True), 0, HISTORY)).where("relation = 'same'")
    apart = day("b") - day("a")
    return pairs.where(apart <= HISTORY).select(article("a"), article("b"), F.when(apart == 0, "within").otherwise("across").alias("leak"), F.round("topic", 6).alias("topic"))


def shadow_clusters(spark, sf_dir):
    """Groups of a day's articles around representatives, with what ties each member to its own; groups of one aren't shown."""
    own = fingerprints(spark, sf_dir, every=True)
    pairs = stored(related(Apart(own, 0, 0)).where((F.col("relation") == "same") & (day("a") == day("b"))))
    found = select.clusters(own.select("id"), pairs.select("a", "b")).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    why = _shared(pairs.join(found, ["a", "b"], "left_semi"), own)
    return why.select(article("b").alias("article_id"), article("a").alias("representative"), joined(F.col("shared")).alias("reason"))


def _across(spark, sf_dir, keep: str = "same", mark=None):
    """Pairs of views a week apart at most that tell the same by the rules across days."""
    return resolve.pairs_across(fingerprints(spark, sf_dir, generated=True, every=True), day("id"), HISTORY, keep, mark)


def entity_matches(spark, sf_dir):
    """Pairs across days that names alone bring together."""
    return _across(spark, sf_dir, "entity").select(article("a"), article("b"), F.round("topic", 6).alias("topic"))


def _stories(spark, sf_dir):
    return articles(spark, sf_dir).select(F.col("article_id").alias("id"), "day", "title", fp.story_entities(F.lit(""), F.col("src_body")).alias("entities"))


def repeat_scan(spark, sf_dir):
    """By day, pairs with the week before that the rules catch, and those that only have a topic in common and no signal: part of an ongoing story if chains have both, else suspicious."""
    own = fingerprints(spark, sf_dir, generated=True, every=True)
    nodes = checkpointed(_stories(spark, sf_dir))
    told = stories.matching_chain(nodes, stories.story_chains(nodes)).select(F.col("id").alias("article_id"), F.lit(True).alias("told"))
    marked = own.withColumn("article_id", article("id")).join(told, "article_id", "left").withColumn("told", F.coalesce("told", F.lit(False)))
    found = resolve.pairs_across(marked, day("id"), HISTORY, "scan", F.col("told"))
    kind = F.when(F.col("same"), "caught").when(F.col("marked"), "ongoing story").otherwise("suspicious").alias("kind")
    return found.groupBy(day("b").cast("long").alias("day"), kind).agg(F.count("*").alias("n"))


def repeat_links(spark, sf_dir):
    """By day, how many links to articles of other days the rules catch: a link counts for both its days."""
    caught = _across(spark, sf_dir).select(F.explode(F.array(day("a").cast("long"), day("b").cast("long"))).alias("day"))
    return caught.groupBy("day").agg(F.count("*").alias("n_links"))


def _headline(c: str = "id"):
    """Headlines of the days: every 23rd article."""
    return F.col(c).bitwiseAND(F.lit((1 << ARTICLE) - 1)) % 23 == 0


def headline_repeats(spark, sf_dir):
    """Articles that repeat a headline of the week before."""
    return _across(spark, sf_dir, "repeats", _headline()).select(article("b").alias("article_id")).distinct()


def near_misses(spark, sf_dir):
    """Headlines and articles of the week before that share an actor, code name or name, and yet aren't the same event."""
    own = fingerprints(spark, sf_dir, generated=True, every=True)
    pairs = resolve.pairs_across(own, day("id"), HISTORY, "misses", _headline())
    return resolve.with_shared_signals(pairs.select("a", "b"), own).select(article("a"), article("b"), joined(F.col("shared")).alias("shared"))


def _ledger(spark, sf_dir):
    own = fingerprints(spark, sf_dir, every=True)
    pairs = stored(related(own))
    old = own.where(day("id") < LAST).select("id")
    return own, pairs, checkpointed(stories.event_ledger(old, pairs.where(day("b") < LAST).select("a", "b", "relation")))


def event_history(spark, sf_dir):
    """Days of each event, on how many it was a headline, and when last."""
    _, _, ledger = _ledger(spark, sf_dir)
    out = stories.event_days(ledger.select("event", day("id").cast("long").alias("day"), _headline().alias("is_headline")))
    return out.select(article("event"), joined(F.col("days").cast("array<string>")).alias("days"), "n_headline_days", "last_headline")


def ledger_matches(spark, sf_dir):
    """The event of the ledger that each of the run's articles belongs to, strictly by relations, or for headlines also loosely."""
    own, pairs, ledger = _ledger(spark, sf_dir)
    reps = checkpointed(stories.event_representatives(ledger))
    new = pairs.where((day("b") == LAST) & (day("a") < LAST))
    strict = stories.ledger_match(new.select("a", "b", "relation"), reps)
    heads = checkpointed(ledger.where(_headline()).select("event").distinct())
    late = (day("id") == LAST).cast("int")  # those of the run meet representatives of headlines' events only
    met = resolve.without_generic(own).where(day("id") == LAST)
    met = stored(met.unionByName(resolve.without_generic(own).join(reps.join(heads, "event", "left_semi").select("id"), "id", "left_semi")))
    rules = resolve.pairs_across(met, late, 1).select("a", "b")
    loose = resolve.pairs_by_id(met, late, (1, 1), lx.HEADLINE_TOPIC).select("a", "b").unionByName(rules).distinct()
    found = stories.headline_match(new.select("a", "b", "relation"), loose, reps, heads)
    return found.join(strict.select("id", "relation"), "id", "left").select(article("id").alias("article_id"), article("event"), F.coalesce("relation", F.lit("loose")).alias("relation"))


def chain_matches(spark, sf_dir):
    """The run's articles that belong to a chain of the days before, the first that shares a name with them."""
    nodes = _stories(spark, sf_dir)
    last = F.lit("2024-01-30").cast("date")
    return stories.matching_chain(nodes.where(F.col("day") == last), stories.story_chains(nodes.where(F.col("day") < last))).select(F.col("id").alias("article_id"), "chain")


_NAMES = [
    view_classes, same_events, same_source_events, event_relations, event_ledger, stream_ledger, story_chains, strongest_to_history, relation_summary, new_across_days, leak_audit, shadow_clusters, entity_matches, repeat_scan, repeat_links,
    headline_repeats, near_misses, event_history, ledger_matches, chain_matches,
]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE_SQL = {
    "view_classes": f"WITH {ARTICLES} SELECT article_id, arg_min(article_id, article_id % 30 * 1099511627776 + article_id) OVER (PARTITION BY title, src_body) AS representative FROM a",
}
