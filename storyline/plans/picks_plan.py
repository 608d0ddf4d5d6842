"""Queries on headlines of all days at once. Articles of equal stems of titles are an event, similar stems tell the same, and every 23rd article has been a headline of its day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import picks, select
from ..operators.base import checkpointed
from .articles_plan import _BOTH, _CLASSES, _same_titles, _title_classes
from .reports_plan import scores
from .tables import ARTICLES, SCORES, articles

DAY = ["day"]


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scored articles as candidates of their day, and the pairs of events that tell the same.

    banned: the event was a headline in the week before; recent: so was one that tells the same; chained: it was told on three days of the week before;
    familiar: the source had a headline in it.
    """
    classes = _title_classes(spark, sf_dir)
    pairs = _same_titles(classes)
    told = checkpointed(articles(spark, sf_dir).select("article_id", "day", "source").join(classes.select(F.col("id").alias("article_id"), F.col("rep").alias("event")), "article_id"))
    heads = told.where("article_id % 23 = 0")
    banned = picks.days_after(heads.select("event", "day"), "event")
    links = select.class_links(told.select(F.col("event").alias("rep")).distinct(), pairs)
    recent = banned.join(links, F.col("event") == F.col("rep")).select(F.col("to").alias("event"), "day").distinct()
    flags = {"banned": (banned, "event"), "recent": (recent, "event"), "chained": (picks.days_after(told.select("event", "day"), "event", least=3), "event"), "familiar": (picks.days_after(heads.select("source", "day"), "source"), "source")}
    rows = scores(spark, sf_dir).where("cyber_gate").join(told.select("article_id", "event"), "article_id")
    for name, (days, key) in flags.items():
        rows = rows.join(days.withColumn(name, F.lit(True)), [key, "day"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return checkpointed(rows), pairs


def tiered_headlines(spark, sf_dir):
    """Three headlines of each day: eligible, then told of lately, then vulnerabilities, then any; events of the ledger's headlines are banned where three others are left."""
    rows, pairs = _candidates(spark, sf_dir)
    found = picks.picked(picks.tiered(rows, DAY), pairs, DAY, refill="fill")
    return found.select("day", F.col("slot").cast("long").alias("slot"), "article_id", F.col("tier").cast("long").alias("tier"))


def annotated_headlines(spark, sf_dir):
    """Headlines of each day by an annotator: candidates are no vulnerabilities, by their points and ids; a signal is an article of over 20 points of urgency and impact.

    The annotator names the day's candidates of most trust; a second opinion names those of most urgency among the twelve first.
    """
    rows, pairs = _candidates(spark, sf_dir)
    own = rows.where("headline_ok AND NOT is_vuln").withColumn("rank", F.struct(-F.col("total"), "article_id")).withColumn("has_signal", F.col("urgency") + F.col("impact") > 20)
    first = lambda among, *order: picks._first(among, DAY, list(order), 3).select("day", F.col("_k").alias("pos"), "article_id")
    answers = first(own.where("day <> DATE'2024-01-05'"), F.desc("trust"), "article_id")
    shown = picks._first(own, DAY, ["rank"], picks.SHOWN).drop("_k")
    proposed = first(shown.where("dayofmonth(day) % 2 = 0"), F.desc("urgency"), "article_id")
    return picks.annotated_headlines(own, answers, proposed, pairs, DAY).select("day", F.col("slot").cast("long").alias("slot"), "article_id")


_NAMES = [tiered_headlines, annotated_headlines]
QUERIES = {f.__name__: f for f in _NAMES}

_WEEK = "generate_series(1, 7)"
_ROWS = f"""
    {ARTICLES}, {SCORES}, {_CLASSES}, {_BOTH}, tl AS (SELECT a.article_id, a.day, a.source, coalesce(rep, a.article_id) AS event FROM a LEFT JOIN mem ON mem.id = a.article_id),
    hd AS (SELECT * FROM tl WHERE article_id % 23 = 0), w AS (SELECT unnest({_WEEK}) AS w),
    ban AS (SELECT DISTINCT event, CAST(day + CAST(w AS INTEGER) AS DATE) AS day FROM hd, w), fam AS (SELECT DISTINCT source, CAST(day + CAST(w AS INTEGER) AS DATE) AS day FROM hd, w),
    lat AS (SELECT DISTINCT o.article_id, CAST(hd.day + CAST(w AS INTEGER) AS DATE) AS day FROM hd JOIN z ON z.a = hd.article_id JOIN tl o ON o.article_id = z.b, w),
    cha AS (SELECT event, d AS day FROM (SELECT DISTINCT event, day, CAST(day + CAST(w AS INTEGER) AS DATE) AS d FROM (SELECT DISTINCT event, day FROM tl), w) GROUP BY ALL HAVING count(*) >= 3),
    r AS (SELECT s.*, tl.event, ban.event IS NOT NULL AS banned, ban.event IS NOT NULL OR lat.article_id IS NOT NULL AS recent, cha.event IS NOT NULL AS chained, fam.source IS NOT NULL AS familiar
        FROM s JOIN tl USING (article_id) LEFT JOIN ban ON ban.event = tl.event AND ban.day = s.day LEFT JOIN lat ON lat.article_id = s.article_id AND lat.day = s.day
        LEFT JOIN cha ON cha.event = tl.event AND cha.day = s.day LEFT JOIN fam ON fam.source = s.source AND fam.day = s.day WHERE cyber_gate)"""
_PICKED = """
    k1 AS (SELECT day, arg_min(article_id, r) AS x FROM cd WHERE r IS NOT NULL GROUP BY day), o1 AS (SELECT c.* FROM cd c LEFT JOIN k1 USING (day) WHERE r IS NOT NULL AND c.article_id <> x AND NOT EXISTS (SELECT 1 FROM z WHERE z.a = x AND z.b = c.article_id)),
    k2 AS (SELECT day, arg_min(article_id, r) AS x FROM o1 GROUP BY day), o2 AS (SELECT c.* FROM o1 c LEFT JOIN k2 USING (day) WHERE c.article_id <> x AND NOT EXISTS (SELECT 1 FROM z WHERE z.a = x AND z.b = c.article_id)),
    k3 AS (SELECT day, arg_min(article_id, r) AS x FROM o2 GROUP BY day), ks AS (SELECT day, 1 AS slot, x FROM k1 UNION ALL SELECT day, 2, x FROM k2 UNION ALL SELECT day, 3, x FROM k3)"""

ORACLE_SQL = {
    "tiered_headlines": f"""
        WITH {_ROWS}, g1 AS (SELECT *, headline_ok AND NOT (banned AND count(*) FILTER (headline_ok AND NOT banned) OVER (PARTITION BY day) >= 3) AS ok1 FROM r),
        g2 AS (SELECT *, ok1 AND NOT (chained AND count(*) FILTER (ok1 AND NOT chained) OVER (PARTITION BY day) >= 3) AS ok FROM g1),
        g3 AS (SELECT *, CASE WHEN ok THEN CASE WHEN recent THEN 1 ELSE 0 END WHEN is_vuln THEN 2 END AS tier FROM g2),
        cd AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, priority DESC, trust DESC, urgency DESC, seq) AS f,
            CASE WHEN tier IS NOT NULL THEN row_number() OVER (PARTITION BY day ORDER BY tier NULLS LAST, ok AND chained, total DESC, priority DESC, trust DESC, urgency DESC, ok AND familiar, seq) END AS r FROM g3), {_PICKED},
        n AS (SELECT day, count(*) AS n FROM ks GROUP BY day), sp AS (SELECT c.day, c.article_id, row_number() OVER (PARTITION BY c.day ORDER BY f) + coalesce(n, 0) AS slot FROM cd c LEFT JOIN n USING (day)
            WHERE NOT EXISTS (SELECT 1 FROM ks WHERE ks.day = c.day AND ks.x = c.article_id))
        SELECT ks.day, slot, x AS article_id, tier FROM ks JOIN cd c ON c.article_id = x UNION ALL SELECT day, slot, article_id, 3 FROM sp WHERE slot <= 3""",
    "annotated_headlines": f"""
        WITH {_ROWS}, v AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, article_id) AS rk, urgency + impact > 20 AS sig FROM r WHERE headline_ok AND NOT is_vuln),
        a1 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY trust DESC, article_id) AS tk FROM v), a2 AS (SELECT day, article_id, sig, CASE WHEN day = DATE '2024-01-05' THEN rk ELSE tk END AS slot FROM a1),
        h AS (SELECT * FROM a2 WHERE slot <= 3), wk AS (SELECT day, slot, row_number() OVER (PARTITION BY day ORDER BY slot) AS j FROM h WHERE NOT sig),
        fr AS (SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY rk) AS j FROM v WHERE sig AND article_id NOT IN (SELECT article_id FROM h)),
        p1 AS (SELECT h.day, h.slot, coalesce(fr.article_id, h.article_id) AS article_id FROM h LEFT JOIN wk ON wk.day = h.day AND wk.slot = h.slot LEFT JOIN fr ON fr.day = h.day AND fr.j = wk.j),
        q1 AS (SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY urgency DESC, article_id) AS slot, count(*) OVER (PARTITION BY day) AS m FROM v WHERE rk <= 12 AND day(day) % 2 = 0),
        p2 AS (SELECT day, slot, article_id FROM q1 WHERE slot <= 3 AND m >= 3 UNION ALL SELECT * FROM p1 WHERE day NOT IN (SELECT day FROM q1 WHERE m >= 3)),
        e1 AS (SELECT *, count(*) FILTER (NOT chained) OVER (PARTITION BY day) >= 3 AS many FROM v), cd AS (SELECT e1.*, row_number() OVER (PARTITION BY e1.day ORDER BY chained, coalesce(p2.slot, 4), rk) AS r
            FROM e1 LEFT JOIN p2 ON p2.day = e1.day AND p2.article_id = e1.article_id WHERE NOT recent AND NOT (chained AND many)), {_PICKED}
        SELECT day, slot, x AS article_id FROM ks""",
}
