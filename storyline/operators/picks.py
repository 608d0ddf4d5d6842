"""Headlines of many reports at once: greedy picks in tiers, with a ban by the ledger, floors, and a quota that is refilled. ``by`` are the columns of one report.

A report wants few headlines, so picks are found in as many rounds as it wants: in each, the first candidate that is left in every report, after which
what tells the same leaves. A round is a minimum by report and an anti join; no report is ever sorted as a whole or held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed, run_key
from .headline import signal_guard

#: Headlines of a report; days that headlines look back; on how many of them an event may have been a headline; candidates shown for a second opinion.
QUOTA, WEEK, REPEATS, SHOWN = 3, 7, 1, 12


def days_after(held: DataFrame, key: str, window: int = WEEK, least: int = REPEATS) -> DataFrame:
    """(key, day): days that have ``least`` or more of the key's days within the ``window`` days before. held: (key, day), repeats count once."""
    after = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", window))).alias("day")
    return held.where("day IS NOT NULL").select(key, "day").distinct().select(key, after).groupBy(key, "day").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key, "day")


def _enough(rows: DataFrame, passes: Column, least: int) -> DataFrame:
    """Rows with ``_enough``: whether ``least`` or more of their report pass. Counted before they are shuffled. rows: (report, …)."""
    n = rows.where(passes).groupBy("report").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("report", F.lit(True).alias("_enough"))
    return rows.join(n, "report", "left").withColumn("_enough", F.coalesce("_enough", F.lit(False)))


def tiered(rows: DataFrame, by: list[str], n: int = QUOTA) -> DataFrame:
    """Rows with ``tier`` and ``at``, their place, and ``fill``, their rank by points: 0 eligible, 1 eligible and told of lately, 2 a vulnerability, null for others.

    rows: (by, article_id, event, total, priority, trust, urgency, seq, headline_ok, is_vuln, banned, chained, recent, familiar). Banned rows aren't
    eligible where ``n`` others are. Then rows of a chain aren't where ``n`` others are, else they come after those. Of equal rows, the
    unfamiliar come first, among the eligible. Null flags are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    held = rows.withColumn("report", run_key(by))
    held = _enough(held, flag("headline_ok") & ~flag("banned"), n).withColumn("_ok", flag("headline_ok") & ~(flag("banned") & F.col("_enough"))).drop("_enough")
    held = _enough(held, F.col("_ok") & ~flag("chained"), n).withColumn("_ok", F.col("_ok") & ~(flag("chained") & F.col("_enough"))).drop("_enough")
    held = held.withColumn("tier", F.when(F.col("_ok"), flag("recent").cast("int")).when(flag("is_vuln"), 2))
    among = lambda c: (F.col("_ok") & flag(c)).cast("int")
    points = [(-F.col(c)).alias(c) for c in ("total", "priority", "trust", "urgency")]
    at = F.struct(among("chained").alias("c"), *points, among("familiar").alias("f"), "seq")
    return held.withColumn("at", at).withColumn("fill", F.struct(*points, "seq")).drop("report", "_ok")


def picked(candidates: DataFrame, pairs: DataFrame, by: list[str], n: int = QUOTA, refill: str | None = None) -> DataFrame:
    """(by, slot, article_id, tier): for each report the first ``n`` in the order of (tier, at, article_id) that don't tell the same as an earlier pick.

    candidates: (by, article_id, event, tier, at); articles of one event tell the same, and so do events in pairs (a, b). The first article of an event
    stands for it, so copies are never paired. Rows without a tier are never picked; with ``refill``, a column to order by, reports of under ``n`` picks are
    filled up in that order, whatever their rows tell, as tier 3. Nulls in ``by`` are a report's key like others. A report without rows has no picks.
    """
    held = checkpointed(candidates.select(*by, run_key(by).alias("report"), "article_id", "event", "tier", "at", *([F.col(refill).alias("fill")] if refill else [])))
    place = F.struct("tier", "at", "article_id")
    events = checkpointed(held.where("tier IS NOT NULL").groupBy("report", "event").agg(F.min(place).alias("place")))
    both = pairs.select(F.col("a").alias("event"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("event"), F.col("a").alias("to")))
    found = told = None
    for slot in range(1, n + 1):
        left = events if told is None else events.join(told, ["report", "event"], "left_anti")
        best = checkpointed(left.groupBy("report").agg(F.min(F.struct("place", "event")).alias("x")).select("report", "x.event", "x.place", F.lit(slot).alias("slot")))
        out = best.select("report", "event").unionByName(best.join(both, "event").select("report", F.col("to").alias("event")))
        told = out if told is None else told.unionByName(out)
        found = best if found is None else found.unionByName(best)
    picks = found.select("report", "slot", F.col("place.article_id").alias("article_id"), F.col("place.tier").alias("tier"))
    if refill:
        had = picks.groupBy("report").agg(F.count("*").cast("int").alias("had"))
        short = held.select("report").distinct().join(had, "report", "left").select("report", F.coalesce("had", F.lit(0)).alias("had")).where(F.col("had") < n)
        spare = held.join(short, "report").join(picks.select("report", "article_id"), ["report", "article_id"], "left_anti")
        spare = spare.groupBy("report", "had", "article_id").agg(F.min("fill").alias("fill"))
        spare = spare.withColumn("_k", F.row_number().over(Window.partitionBy("report").orderBy("fill", "article_id"))).where(F.col("_k") <= n)
        picks = picks.unionByName(spare.select("report", (F.col("had") + F.col("_k")).alias("slot"), "article_id", F.lit(3).alias("tier")).where(F.col("slot") <= n))
    return picks.join(held.select("report", *by).distinct(), "report").select(*by, "slot", "article_id", "tier")


def _first(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n)


def annotated(pool: DataFrame, answers: DataFrame, by: list[str], n: int = QUOTA) -> DataFrame:
    """(by, slot, article_id): an annotator's first ``n`` answers that are in the pool, each once; the pool's first ``n`` for reports without any.

    Of these, picks without a signal give way to the pool's first unused rows with one. pool: (by, article_id, rank, has_signal); answers: (by, pos, article_id).
    """
    known = answers.join(pool.select(*by, "article_id"), [*by, "article_id"], "left_semi")
    given = _first(known, by, ["pos", "article_id"], n).groupBy(*by, "article_id").agg(F.min("_k").alias("_k"))
    default = _first(pool.join(given.select(*by).distinct(), by, "left_anti"), by, ["rank"], n).select(*by, "article_id", "_k")
    picks = checkpointed(given.unionByName(default).withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("_k"))).drop("_k"))
    signals = pool.select(*by, "article_id", F.coalesce("has_signal", F.lit(False)).alias("has_signal"))
    # At most n picks are in the pool, so its first 2n with a signal hold all that can be swapped in.
    spare = _first(pool.where("has_signal"), by, ["rank"], 2 * n).select(*by, "rank", "article_id", "has_signal")
    return checkpointed(signal_guard(picks.join(signals, [*by, "article_id"]), spare, by))


def second_opinion(picks: DataFrame, pool: DataFrame, proposed: DataFrame, by: list[str], n: int = QUOTA, shown: int = SHOWN) -> DataFrame:
    """(by, slot, article_id): the proposed ids where they are ``n`` different ones of the picks and the ``shown`` first of the pool, else the picks.

    Ids that weren't shown and repeats are passed over. picks: (by, slot, article_id); pool: (by, article_id, rank); proposed: (by, pos, article_id).
    """
    seen = _first(pool, by, ["rank"], shown).select(*by, "article_id").unionByName(picks.select(*by, "article_id")).distinct()
    once = proposed.join(seen, [*by, "article_id"], "left_semi").groupBy(*by, "article_id").agg(F.min("pos").alias("pos"))
    sane = once.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") == n).select(*by)
    new = once.join(sane, by, "left_semi").withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    return picks.select(*by, "slot", "article_id").join(sane, by, "left_anti").unionByName(new.select(*by, "slot", "article_id"))


def annotated_headlines(pool: DataFrame, answers: DataFrame, proposed: DataFrame, pairs: DataFrame, by: list[str], n: int = QUOTA) -> DataFrame:
    """(by, slot, article_id) of each report's headlines by an annotator: answers, signal guard, second opinion, then the first ``n`` of the picks and the
    pool after them that belong to no chain, aren't told of lately and tell of different events.

    pool: (by, article_id, event, rank, has_signal, chained, recent); columns of ``by`` aren't null. Where under ``n`` rows are outside of chains, those
    of chains come last. Reports may end up with fewer than ``n``, and none has a row that was told of lately.
    """
    picks = checkpointed(second_opinion(annotated(pool, answers, by, n), pool, proposed, by, n))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    held = _enough(pool.withColumn("report", run_key(by)), ~flag("chained"), n).where(~flag("chained") | ~F.col("_enough")).where(~flag("recent")).join(picks, [*by, "article_id"], "left")
    candidates = held.withColumn("tier", flag("chained").cast("int")).withColumn("at", F.struct(F.coalesce("slot", F.lit(n + 1)).alias("slot"), F.col("rank").alias("rank")))
    return picked(candidates, pairs, by, n).select(*by, "slot", "article_id")
