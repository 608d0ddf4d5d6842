"""Queries on headline editing and audits of reports, over scores and layers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import headline as hd
from ..operators import report as rp
from .reports_plan import _LAYERS, _SECTIONS, DAY, _layers, _sections, scores
from .tables import ARTICLES, ORDER, SCORES, articles, joined, table


def _picks(spark, sf_dir):
    own = _sections(spark, sf_dir)
    top = own.where("section = 'headline'")
    slot = F.row_number().over(hd.Window.partitionBy("day").orderBy("rank"))
    return top.withColumn("slot", slot), own.where("section = 'body'")


def guarded_headlines(spark, sf_dir):
    """Headlines with a signal; a signal is an odd id."""
    picks, pool = _picks(spark, sf_dir)
    odd = F.col("article_id") % 2 == 1
    return hd.signal_guard(picks.withColumn("has_signal", odd), pool.withColumn("has_signal", odd), DAY).select("day", F.col("slot").cast("long").alias("slot"), "article_id")


def enforced_labels(spark, sf_dir):
    own = hd.enforced_labels(scores(spark, sf_dir), F.col("article_id") % 2 == 0, F.col("article_id") % 3 == 0)
    return own.select("article_id", "category", F.col("total").cast("long").alias("total"), "downgraded", "unverified", "headline_ok")


def verified_duplicates(spark, sf_dir):
    from .sources_plan import strongest_relations

    own = hd.verified_duplicates(scores(spark, sf_dir), strongest_relations(spark, sf_dir).withColumnRenamed("article_id", "id"))
    return own.select("article_id", "dup_flag", "relation")


def _alike(own):
    """Pairs of a day's articles that tell the same, here of one source, both ways round."""
    x, y = own.select("day", "article_id", "source").alias("x"), own.select("day", "article_id", "source").alias("y")
    met = x.join(y, (F.col("x.day") == F.col("y.day")) & (F.col("x.source") == F.col("y.source")) & (F.col("x.article_id") != F.col("y.article_id")))
    return met.select(F.col("x.article_id").alias("article_id"), F.col("y.article_id").alias("other"))


def distinct_headlines(spark, sf_dir):
    """Headlines of three sources, as far as the pool has them. Of the pool, only a source's first row can come in, so only those and the picks are paired."""
    picks, pool = _picks(spark, sf_dir)
    first = pool.groupBy("day", "source").agg(F.min(F.struct("rank", "article_id")).alias("x")).select("day", "source", "x.*")
    alike = _alike(picks.select("day", "article_id", "source").unionByName(first.select("day", "article_id", "source")))
    return hd.replaced_within(picks, first, alike, DAY).select("day", F.col("slot").cast("long").alias("slot"), "article_id")


def editor_categories(spark, sf_dir):
    own = scores(spark, sf_dir)
    fix = own.where("article_id % 4 = 0").select("article_id", F.when(F.col("article_id") % 8 == 0, "urun_icerik").when(F.col("article_id") % 12 == 0, "none such").otherwise("phishing_sosyal_muhendislik").alias("category"))
    return hd.category_fixes(own, fix).select("article_id", "category", "was", F.col("total").cast("long").alias("total"))


def editor_swaps(spark, sf_dir):
    """An editor proposes each day to swap the k-th headline with the k-th body row, and the first with the fourth."""
    picks, body = _picks(spark, sf_dir)
    k = lambda t, c: t.withColumn("k", F.row_number().over(hd.Window.partitionBy("day").orderBy("rank"))).select("day", "k", F.col("article_id").alias(c))
    both = k(picks, "down").join(k(body, "up"), ["day", "k"]).select("day", F.col("k").alias("pos"), "down", "up")
    more = k(picks, "down").where("k = 1").drop("k").join(k(body, "up").where("k = 4").drop("k"), "day").select("day", F.lit(4).alias("pos"), "down", "up")
    return hd.editor_swaps(both.unionByName(more), picks, body, body.where("article_id % 5 = 0"), DAY).select("day", F.col("pos").cast("long").alias("pos"), "down", "up", "action")


def editor_texts(spark, sf_dir):
    own = articles(spark, sf_dir).select("article_id", "source", F.concat("source", F.lit(" has "), F.col("article_id").cast("string")).alias("out_title"))
    fix = own.where("article_id % 3 > 0").select("article_id", F.concat(F.lit("In all "), "source", F.lit(" has "), (F.col("article_id") + F.when(F.col("article_id") % 3 == 2, 1).otherwise(0)).cast("string")).alias("text"))
    return hd.text_fixes(own, fix, "out_title").select("article_id", "out_title", "action")


def silent_losses(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("n", tx.word_count(F.col("src_body")))
    items = a.select(F.col("lang").alias("source"), F.lit(True).alias("kept"), ((F.col("lang") != "de") & (F.col("n") > 9)).alias("text_ok"), (F.col("lang") == "en").alias("in_pool"), F.lit(False).alias("seen"))
    reasons = a.groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("seen"), F.count_if(F.col("lang") == "fr").alias("filtered"))
    return rp.silent_losses(rp.source_funnel(items, items), reasons)


def violation_counts(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    found = rp.violations(layers, layers.where("article_id % 13 = 0").select("day", "article_id").distinct(), DAY)
    return rp.grouped_ids(found, [], "kind").select("kind", "n", F.array_join("first", ",").alias("first"))


def feed_freshness(spark, sf_dir):
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 200).alias("n_words"))
    return rp.feed_freshness(own, F.lit("2024-01-31 00:00:00").cast("timestamp")).withColumn("newest_hours", F.round("newest_hours", 4))


def supplies(spark, sf_dir):
    return rp.supply(scores(spark, sf_dir), DAY, 0.1).withColumn("dup_share", F.round("dup_share", 6))


def high_dropped(spark, sf_dir):
    own = _sections(spark, sf_dir)
    reported = own.where("section = 'headline' OR article_id % 2 = 0")
    return rp.high_dropped(scores(spark, sf_dir), reported, DAY).select("day", "article_id", F.col("total").cast("long").alias("total"), F.col("k").cast("long").alias("k"))


def scoring_log(spark, sf_dir):
    """Each score's placement and, if it was dropped, why."""
    own = _sections(spark, sf_dir)
    s = scores(spark, sf_dir)
    reasons = s.select("day", "article_id", F.when(~F.col("cyber_gate"), "gate").when(F.col("dup_flag"), "duplicate").alias("reason"))
    out = rp.placements(s, own.where("section = 'headline'"), own.where("rank <= 10"), own, reasons, DAY)
    return out.select("day", "article_id", "placement", "reason", F.col("total").cast("long").alias("total"))


def headline_trace(spark, sf_dir):
    return rp.headline_trace(_layers(spark, sf_dir).where("section = 'headline'"), DAY).select("day", F.col("layer_no").cast("long").alias("layer_no"), "gone", "come")


def report_meta(spark, sf_dir):
    s = scores(spark, sf_dir).groupBy("day").agg(F.count_if(F.col("cyber_gate") & ~F.col("dup_flag")).alias("fresh"))
    return rp.report_meta(_sections(spark, sf_dir).where("rank <= 4"), s, DAY).select("day", "n_items", "fresh", F.col("least").cast("long").alias("least"), "status")


def unexplained_exits(spark, sf_dir):
    s = scores(spark, sf_dir)
    reasons = s.select("day", "article_id", F.when(~F.col("cyber_gate"), "gate").alias("reason"))
    return rp.unexplained(s, s.where("total > 50"), reasons, DAY)


def repaired_body(spark, sf_dir):
    """A body after a layer that repeated some rows and lost others, of which it named a reason for some."""
    body = _sections(spark, sf_dir).where("section = 'body'").select("day", "article_id", "pos")
    now = body.where("article_id % 5 > 0")
    now = now.unionByName(now.where("article_id % 3 = 0").withColumn("pos", F.col("pos") + 100_000))
    reasons = body.where("article_id % 10 = 0").select("day", "article_id", F.lit("weak").alias("reason"))
    return rp.repaired(body, now, reasons, DAY).select("day", "article_id", F.col("pos").cast("long").alias("pos"))


def flagged_out(spark, sf_dir):
    body = _sections(spark, sf_dir).where("section = 'body'").select("day", "article_id")
    return rp.flagged_out(body, body.where("article_id % 7 = 1"), enabled=True)


def scored_views(spark, sf_dir):
    """Articles with their scores, or with what counts where there is none."""
    out = rp.with_scores(articles(spark, sf_dir).select("article_id"), scores(spark, sf_dir))
    return out.select("article_id", "category", "cyber_gate", F.col("total").cast("long").alias("total"))


_NAMES = [
    guarded_headlines, enforced_labels, verified_duplicates, distinct_headlines, editor_categories, editor_swaps, editor_texts, silent_losses, violation_counts, feed_freshness, supplies, high_dropped,
    scoring_log, headline_trace, report_meta, unexplained_exits, repaired_body, flagged_out, scored_views,
]
QUERIES = {f.__name__: f for f in _NAMES}

_PICKS = f"{_SECTIONS}, h AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank) AS slot FROM p WHERE section = 'headline'), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank) AS k FROM p WHERE section = 'body')"
_SUM = "strategic + impact + urgency + trust"

ORACLE_SQL = {
    "guarded_headlines": f"""
        WITH {_PICKS}, w AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY slot) AS j FROM h WHERE article_id % 2 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank) AS j FROM b WHERE article_id % 2 = 1)
        SELECT h.day, h.slot, coalesce(f.article_id, h.article_id) AS article_id FROM h LEFT JOIN w ON w.day = h.day AND w.slot = h.slot LEFT JOIN f ON f.day = h.day AND f.j = w.j""",
    "enforced_labels": f"""
        WITH {SCORES}, d AS (SELECT *, (category = 'zafiyet_aktif_apt' AND article_id % 2 > 0) OR (category = 'casus_yazilim' AND article_id % 3 > 0) AS downgraded FROM s)
        SELECT article_id, CASE WHEN downgraded THEN 'zafiyet_rutin' ELSE category END AS category, total, downgraded, category = 'nation_state_apt' AND article_id % 2 > 0 AS unverified, headline_ok AND NOT downgraded AS headline_ok FROM d""",
    "verified_duplicates": f"""
        WITH {SCORES}, {ARTICLES}, g AS (SELECT article_id, source, lang, md5(src_body) AS h FROM a), p AS (SELECT y.article_id, CASE WHEN x.source = y.source THEN 0 WHEN x.lang = y.lang THEN 1 END AS r FROM g y JOIN g x ON x.h = y.h AND x.article_id < y.article_id),
        r AS (SELECT article_id, min(r) AS r FROM p WHERE r IS NOT NULL GROUP BY article_id)
        SELECT article_id, dup_flag AND coalesce(r = 0, false) AS dup_flag, CASE r WHEN 0 THEN 'same' WHEN 1 THEN 'new_development' END AS relation FROM s LEFT JOIN r USING (article_id)""",
    "distinct_headlines": f"""
        WITH {_PICKS}, h1 AS (SELECT day, article_id, source FROM h WHERE slot = 1), h2 AS (SELECT day, article_id, source FROM h WHERE slot = 2), h3 AS (SELECT day, article_id, source FROM h WHERE slot = 3),
        r2 AS (SELECT b.day, arg_min(b.article_id, rank) AS n, arg_min(b.source, rank) AS src FROM b JOIN h1 ON h1.day = b.day AND h1.source <> b.source GROUP BY b.day),
        k2 AS (SELECT h2.day, CASE WHEN h1.source = h2.source THEN coalesce(n, h2.article_id) ELSE h2.article_id END AS article_id, CASE WHEN h1.source = h2.source THEN coalesce(src, h2.source) ELSE h2.source END AS source
            FROM h2 JOIN h1 ON h1.day = h2.day LEFT JOIN r2 ON r2.day = h2.day),
        r3 AS (SELECT b.day, arg_min(b.article_id, rank) AS n FROM b JOIN h1 ON h1.day = b.day AND h1.source <> b.source JOIN k2 ON k2.day = b.day AND k2.source <> b.source AND k2.article_id <> b.article_id GROUP BY b.day),
        k3 AS (SELECT h3.day, CASE WHEN h3.source IN (h1.source, k2.source) THEN coalesce(n, h3.article_id) ELSE h3.article_id END AS article_id FROM h3 JOIN h1 ON h1.day = h3.day JOIN k2 ON k2.day = h3.day LEFT JOIN r3 ON r3.day = h3.day)
        SELECT day, 1 AS slot, article_id FROM h1 UNION ALL SELECT day, 2, article_id FROM k2 UNION ALL SELECT day, 3, article_id FROM k3""",
    "editor_categories": f"""
        WITH {SCORES}, f AS (SELECT *, CASE WHEN article_id % 8 = 0 THEN 'urun_icerik' WHEN article_id % 12 = 0 THEN NULL WHEN article_id % 4 = 0 THEN 'phishing_sosyal_muhendislik' END AS new FROM s)
        SELECT article_id, coalesce(new, category) AS category, CASE WHEN new <> category THEN category END AS was, CASE WHEN cyber_gate AND coalesce(new, category) NOT IN ('urun_icerik', 'siber_disi') THEN {_SUM} ELSE 0 END AS total FROM f""",
    "editor_texts": """
        SELECT doc_id AS article_id, CASE WHEN doc_id % 3 = 1 THEN 'In all ' ELSE '' END || source || ' has ' || doc_id AS out_title, CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'applied' ELSE 'facts differ' END AS action FROM documents""",
    "silent_losses": f"""
        WITH {ARTICLES}, f AS (SELECT lang AS source, count(*) FILTER (lang <> 'de' AND len(regexp_extract_all(src_body, '\\S+')) > 9) AS text_ok FROM a GROUP BY lang)
        SELECT source, CASE WHEN text_ok = 0 THEN 'extraction zero' ELSE 'dedup zero' END AS alarm FROM f WHERE text_ok = 0 OR source = 'fr'""",
    "violation_counts": f"""
        WITH {_LAYERS}, v AS (SELECT 'unexplained' AS kind, article_id FROM l WHERE layer_no = 2 AND section = 'dropped' AND reason IS NULL UNION ALL SELECT 'category', article_id FROM l WHERE section = 'headline' AND NOT headline_ok
            UNION ALL SELECT 'banned', article_id FROM l x WHERE section = 'headline' AND article_id % 13 = 0 AND NOT EXISTS (SELECT 1 FROM l y WHERE y.article_id = x.article_id AND y.layer_no = x.layer_no - 1 AND y.section = 'headline'))
        SELECT kind, count(*) AS n, array_to_string(list_sort(list(article_id))[1:20], ',') AS first FROM v GROUP BY kind""",
    "feed_freshness": """
        WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS source, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') / 3600 AS age, event_id % 200 AS w FROM events)
        SELECT source, count(*) AS n, count(*) FILTER (age IS NULL OR age <= 96) AS in_window, count(*) FILTER ((age IS NULL OR age <= 96) AND w >= 100) AS rescuable, round(min(age), 4) AS newest_hours FROM e GROUP BY source""",
    "supplies": f"""
        WITH {SCORES}, d AS (SELECT day, count(*) FILTER (cyber_gate) AS cyber, count(*) FILTER (cyber_gate AND dup_flag) AS dups FROM s GROUP BY day)
        SELECT day, cyber, dups, cyber - dups AS fresh, round(CASE WHEN cyber > 0 THEN dups / cyber ELSE 0.0 END, 6) AS dup_share, CASE WHEN cyber > 0 THEN dups / cyber ELSE 0.0 END > 0.1 AS relaxed FROM d""",
    "high_dropped": f"""
        WITH {_SECTIONS}, q AS (SELECT * FROM p WHERE section = 'headline' OR article_id % 2 = 0), m AS (SELECT day, min(total) AS lowest FROM q WHERE section = 'headline' GROUP BY day),
        k AS (SELECT s.day, s.article_id, s.total, row_number() OVER (PARTITION BY s.day ORDER BY s.total DESC, s.article_id) AS k FROM s JOIN m USING (day) WHERE cyber_gate AND NOT no_points AND s.total > lowest AND s.article_id NOT IN (SELECT article_id FROM q))
        SELECT * FROM k WHERE k <= 8""",
    "scoring_log": f"""
        WITH {_SECTIONS} SELECT s.day, s.article_id, CASE WHEN section = 'headline' THEN 'headline' WHEN rank <= 10 THEN 'top10' WHEN rank IS NOT NULL THEN 'body' ELSE 'dropped' END AS placement,
            CASE WHEN NOT s.cyber_gate THEN 'gate' WHEN s.dup_flag THEN 'duplicate' ELSE '' END AS reason, s.total FROM s LEFT JOIN p ON p.article_id = s.article_id""",
    "headline_trace": f"""
        WITH {_LAYERS}, x AS (SELECT day, layer_no, article_id FROM l WHERE section = 'headline'), c AS (SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY article_id) AS k FROM x WHERE layer_no = 2 AND article_id NOT IN (SELECT article_id FROM x WHERE layer_no = 1)
            AND day IN (SELECT day FROM x WHERE layer_no = 1)), g AS (SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY article_id) AS k FROM x WHERE layer_no = 1 AND article_id NOT IN (SELECT article_id FROM x WHERE layer_no = 2) AND day IN (SELECT day FROM x WHERE layer_no = 2))
        SELECT coalesce(g.day, c.day) AS day, 2 AS layer_no, g.article_id AS gone, c.article_id AS come FROM g FULL JOIN c ON g.day = c.day AND g.k = c.k""",
    "report_meta": f"""
        WITH {_SECTIONS}, f AS (SELECT day, count(*) FILTER (cyber_gate AND NOT dup_flag) AS fresh FROM s GROUP BY day), n AS (SELECT day, count(*) AS n_items FROM p WHERE rank <= 4 GROUP BY day),
        m AS (SELECT day, n_items, fresh, CAST(greatest(4, least(10, round_even(0.45 * fresh, 0))) AS BIGINT) AS least FROM n JOIN f USING (day)) SELECT *, CASE WHEN n_items < least THEN 'thin' ELSE 'ok' END AS status FROM m""",
    "unexplained_exits": f"WITH {SCORES} SELECT day, article_id FROM s WHERE total <= 50 AND cyber_gate",
    "repaired_body": f"""
        WITH {_SECTIONS}, x AS (SELECT day, article_id, pos, CASE WHEN article_id % 5 > 0 THEN 1 ELSE 0 END AS t FROM p WHERE section = 'body' AND article_id % 10 > 0)
        SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY t, pos, article_id) AS pos FROM x""",
    "flagged_out": f"WITH {_SECTIONS} SELECT day, article_id FROM p WHERE section = 'body' AND article_id % 7 <> 1",
    "scored_views": f"WITH {SCORES} SELECT doc_id AS article_id, coalesce(category, 'veri_ihlali') AS category, coalesce(cyber_gate, true) AS cyber_gate, coalesce(total, 1) AS total FROM documents LEFT JOIN s ON s.article_id = doc_id",
}
