"""Queries on scores, reports, audits, state tables and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking as rk
from ..operators.base import checkpointed, shared_dir
from ..operators import report as rp
from ..sources import feeds, sinks
from ..streaming import stream
from .articles_plan import ORACLE_SQL as _ARTICLES_SQL
from .tables import ARTICLES, FIRST_DAY, ORDER, SCORES, articles, day_of, raw_scores, streamed, table

DAY = ["day"]
NOW = "2024-01-25 00:00:00"


def scores(spark, sf_dir):
    return rk.scored(raw_scores(spark, sf_dir))


def score_totals(spark, sf_dir):
    return scores(spark, sf_dir).select("article_id", "category", "cyber_gate", "dup_flag", *[F.col(d).cast("long").alias(d) for d in rk.DIMENSIONS], F.col("total").cast("long").alias("total"))


def daily_rank(spark, sf_dir):
    own = scores(spark, sf_dir).where("cyber_gate AND NOT dup_flag")
    return rk.ranked(own, DAY).select("day", "article_id", F.col("total").cast("long").alias("total"), F.col("rank").cast("long").alias("rank"))


def rescued_rank(spark, sf_dir):
    return rk.with_rescue(scores(spark, sf_dir), DAY).select("day", "article_id", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"))


def critique_scope(spark, sf_dir):
    return rk.critique_scope(scores(spark, sf_dir), DAY).select("day", "article_id")


def _recent(spark, sf_dir):
    return scores(spark, sf_dir).where("cyber_gate AND NOT dup_flag").withColumn("recent", F.col("article_id") % 7 == 0)


def headlines(spark, sf_dir):
    return rk.headlines(_recent(spark, sf_dir), DAY).select("day", "article_id", F.col("tier").cast("long").alias("tier"), F.col("slot").cast("long").alias("slot"))


def soft_gate(spark, sf_dir):
    return rk.soft_gate(scores(spark, sf_dir), DAY, F.col("total") >= 60).select("day", "article_id")


def _sections(spark, sf_dir):
    """Ranked rows; the three best that may be headlines are, the rest are body."""
    own = rk.ranked(_recent(spark, sf_dir), DAY)
    top = Window.partitionBy("day").orderBy(F.when(F.col("headline_ok"), 0).otherwise(1), "rank")
    head = F.col("headline_ok") & (F.row_number().over(top) <= 3)
    return own.withColumn("section", F.when(head, "headline").otherwise("body")).withColumn("pos", F.col("rank"))


def numbered_report(spark, sf_dir):
    return rk.numbered(_sections(spark, sf_dir), DAY).select("day", "article_id", "part", F.col("number").cast("long").alias("number"))


def executive_set(spark, sf_dir):
    return rk.executive(_sections(spark, sf_dir), DAY).select("day", "article_id", "section")


def rank_inversions(spark, sf_dir):
    sections = _sections(spark, sf_dir).withColumn("section", F.when(F.col("article_id") % 11 == 0, "headline").otherwise("body"))
    return rk.rank_inversions(sections, DAY).select("day", "article_id", F.col("total").cast("long").alias("total"), F.col("lowest").cast("long").alias("lowest"))


def annotation_batches(spark, sf_dir):
    return rk.batches(articles(spark, sf_dir), DAY, 5).select("article_id", F.col("batch").cast("long").alias("batch"))


def top_signals(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.col("event_id").alias("id"), F.round("value", 6).alias("score")).where("score IS NOT NULL")
    return rk.top_signals(own, {"click": 5, "view": 1}, 12)


def admitted_events(spark, sf_dir):
    """Events within 96 hours of the clock, within 168 of two slow sources."""
    own = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").alias("pub_ts"))
    hours = spark.createDataFrame([("purchase", 168), ("signup", 168)], "source string, hours int")
    return stream.admitted(own, hours, NOW).select("event_id", "source")


def source_funnel(spark, sf_dir):
    a = articles(spark, sf_dir)
    items = a.select("source", (F.col("article_id") % 4 != 0).alias("kept"), (tx.word_count(F.col("src_body")) >= 100).alias("text_ok"), ((F.col("article_id") % 4 != 0) & (F.col("article_id") % 3 == 0) & (tx.word_count(F.col("src_body")) >= 100)).alias("in_pool"), (F.col("article_id") % 5 == 0).alias("seen"))
    return rp.source_funnel(items, a)


def elimination_funnel(spark, sf_dir):
    own = scores(spark, sf_dir).withColumn("reported", F.col("total") >= 40)
    reason = F.when(~F.col("reported"), F.when(~F.col("cyber_gate"), "gate").when(F.col("dup_flag"), "duplicate").when(F.col("no_points"), "category"))
    out = rp.elimination_funnel(own.withColumn("reason", reason), DAY)
    told = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("by_reason", F.create_map().cast("map<string,bigint>")))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("by_reason", told)


def clean_streak(spark, sf_dir):
    days = articles(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    return rp.clean_streak(days.withColumn("dirty", F.dayofmonth("day") % 9 == 0))


def label_confusion(spark, sf_dir):
    """Labels of quality against a rule of thumb: at least 100 words."""
    own = articles(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "article_id"), "article_id")
    told = lambda c: F.when(c, "same").otherwise("unrelated")
    return rp.confusion(own.select(told(F.col("quality") == 1).alias("label"), told(tx.word_count(F.col("src_body")) >= 100).alias("predicted")))


def report_gaps(spark, sf_dir):
    """For each day of a user's purchases, days since the last one before it."""
    days = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return rp.gaps(days, ["user_id"]).withColumn("gap", F.col("gap").cast("long"))


def _layers(spark, sf_dir):
    s = scores(spark, sf_dir).where("cyber_gate").select("day", "article_id", "headline_ok", "total", "dup_flag")
    one = s.withColumn("layer_no", F.lit(1)).withColumn("section", F.when(F.col("total") >= 60, "headline").otherwise("body")).withColumn("reason", F.lit(None).cast("string"))
    gone = F.col("dup_flag") | (F.col("article_id") % 17 == 0)
    two = one.withColumn("layer_no", F.lit(2)).withColumn("section", F.when(gone, "dropped").when(F.col("total") >= 50, "headline").otherwise("body"))
    two = two.withColumn("reason", F.when(F.col("dup_flag"), "duplicate"))
    return one.unionByName(two).withColumn("pos", F.col("article_id"))


def report_violations(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    banned = layers.where("article_id % 13 = 0").select("day", "article_id").distinct()
    return rp.violations(layers, banned, DAY)


def report_decisions(spark, sf_dir):
    return rp.decisions(_layers(spark, sf_dir), DAY)


def corrected_scores(spark, sf_dir):
    own = scores(spark, sf_dir).select("article_id", "category", "cyber_gate", F.col("total").cast("long").alias("total"))
    fix = own.where("article_id % 6 = 0").select("article_id", F.when(F.col("article_id") % 12 == 0, "siber_disi").otherwise("veri_ihlali").alias("category"), "cyber_gate", (F.col("total") + 1).alias("total"))
    return rp.corrected(own, fix, ["category", "total"])


def content_or_source(spark, sf_dir):
    a = articles(spark, sf_dir)
    content = a.where("article_id % 3 = 0").select("article_id", F.reverse("title").alias("out_title"), F.lit("body").alias("out_body"))
    return rp.with_content(a, content, words=5).select("article_id", "out_title", "out_body", "is_fallback")


def history_upsert(spark, sf_dir):
    a = articles(spark, sf_dir).select("day", "article_id", "title", "src_body")
    today = a.where("article_id % 10 = 0").withColumn("day", F.lit("2024-01-30").cast("date"))
    out = sinks.upserted(a, today, F.lit("2024-01-30").cast("date"), 7, {"title": 40, "src_body": 60})
    return out.select("day", "article_id", "title", F.md5("src_body").alias("body"))


def ledger_after_run(spark, sf_dir):
    """The seen-link ledger after a published run of the last day."""
    links = table(spark, sf_dir, "pages").select(day_of("page_id").alias("day"), tx.canonical_url(F.col("url")).alias("link"), F.concat(F.lit(" t\t"), F.col("page_id").cast("string")).alias("title"))
    last = F.lit("2024-01-30").cast("date")
    return sinks.appended_ledger(links.where("day < DATE'2024-01-30'"), links, last, True)


def reconciled_body(spark, sf_dir):
    own = _sections(spark, sf_dir)
    body = own.where("section = 'body'")
    return rp.reconciled(body, body.where("article_id % 5 = 1"), own.where("section = 'headline'"), DAY).select("day", "article_id", F.col("pos").cast("long").alias("pos"))


def overridden_report(spark, sf_dir):
    own = _sections(spark, sf_dir).select("day", "section", "article_id", "pos")
    op = F.when(F.col("article_id") % 9 == 0, "delete").when(F.col("article_id") % 9 == 1, "replace")
    changes = own.withColumn("op", op).where("op IS NOT NULL").withColumn("by_id", F.col("article_id") + 1_000_000)
    return rp.overridden(own, changes).select("day", "section", "article_id", F.col("pos").cast("long").alias("pos"))


def fresh_supply(spark, sf_dir):
    own = scores(spark, sf_dir).groupBy("day").agg(F.count_if(F.col("cyber_gate") & ~F.col("dup_flag")).alias("fresh"), F.count_if("dup_flag").alias("dups"))
    return own.withColumn("least", tx.floor_of(F.col("fresh")).cast("long"))


#: Articles that one question asks for.
BATCH = 12


def answers_to_rows(spark, sf_dir):
    """Annotators' answers in the shapes that were seen, and two that can't be used, back to a row for each article.

    By batch in turn: a map; the map in a list; a list of maps of one id; contents without ids, in order; a fenced wrapper after a thinking block; contents
    with ids; contents without ids, one of them missing; a map that breaks off.
    """
    own = raw_scores(spark, sf_dir).select(F.floor(F.col("article_id") / BATCH).alias("batch"), "article_id", "seq", F.col("source").alias("tr_title"), F.col("category").alias("kat"))
    content = F.struct("tr_title", "kat")
    x = own.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", "article_id", content.alias("v")))).alias("x"))  # BATCH rows at most
    entry = lambda r: F.struct(r["article_id"].cast("string").alias("key"), r["v"].alias("value"))
    map_, each = F.to_json(F.map_from_entries(F.transform("x", entry))), F.to_json(F.transform("x", lambda r: F.map_from_entries(F.array(entry(r)))))
    bare, named = F.transform("x", lambda r: r["v"]), F.to_json(F.transform("x", lambda r: F.struct(r["article_id"].alias("id"), r["v"]["tr_title"].alias("tr_title"), r["v"]["kat"].alias("kat"))))
    fenced = F.concat(F.lit('<think>{"9": {"kat": "no"}}</think>Here it is:\n```json\n{"summaries": '), map_, F.lit("}\n```\nDone."))
    shapes = [map_, F.concat(F.lit("["), map_, F.lit("]")), each, F.to_json(bare), fenced, named, F.to_json(F.slice(bare, F.lit(2), F.size("x"))), F.substring(map_, F.lit(1), F.length(map_) - 1)]
    text = F.coalesce(*[F.when(F.col("batch") % len(shapes) == k, v) for k, v in enumerate(shapes)])
    return feeds.answers(x.select("batch", text.alias("text")), asked=own.select("batch", "article_id", "seq")).select("batch", "article_id", F.get_json_object("value", "$.kat").alias("category"))


def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: articles without repeated content, scored, ranked by day, three headlines and the report's order."""
    a = articles(spark, sf_dir).withColumn("h", tx.content_hash(F.col("title"), F.col("src_body")))
    first = a.groupBy("h").agg(F.min("article_id").alias("article_id"))
    own = scores(spark, sf_dir).join(first.select("article_id"), "article_id", "left_semi").where("cyber_gate AND NOT dup_flag AND total > 0")
    ranked = rk.ranked(own, DAY)
    pick = F.row_number().over(Window.partitionBy("day").orderBy(F.when(F.col("headline_ok"), 0).otherwise(1), "rank"))
    return ranked.select("day", F.col("rank").cast("long").alias("rank"), "article_id", "category", F.col("total").cast("long").alias("total"), (F.col("headline_ok") & (pick <= 3)).alias("is_headline"))


def _events_stream(spark, sf_dir):
    return streamed(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("pub_ts"), "user_id", "value")


def _folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid4().hex}"


def stream_funnel(spark, sf_dir):
    found = stream.drained(stream.funnel(_events_stream(spark, sf_dir)), _folder(spark), "complete")
    return found.select(F.to_date("start").alias("day"), "source", "n", F.round("value", 4).alias("value"))


def stream_unseen(spark, sf_dir):
    return stream.drained(stream.unseen(_events_stream(spark, sf_dir), "user_id"), _folder(spark)).select("user_id").distinct()


def stream_weekly(spark, sf_dir):
    """Events of seven days by source, a window from each day on."""
    found = stream.drained(stream.funnel(_events_stream(spark, sf_dir), "7 days", "1 day"), _folder(spark), "complete")
    return found.select(F.to_date("start").alias("day"), "source", "n", F.round("value", 4).alias("value"))


def stream_late(spark, sf_dir):
    """Events of users as sources, split into those in their source's window and late ones: users whose purchases are errors of the last five days have the wide one."""
    own = _events_stream(spark, sf_dir).select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "pub_ts")
    now = F.lit(NOW).cast("timestamp")
    line = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm"), F.lit(" | "), F.upper("event_type"), F.lit(" - u"), F.col("user_id").cast("string"), F.lit(": late"))
    failed = feeds.failed_sources(table(spark, sf_dir, "events").select(line.alias("value")), F.lit("2024-01-20 00:00:00").cast("timestamp"), ["PURCHASE"])
    reports = articles(spark, sf_dir).where("day <= DATE'2024-01-23'").select("day")
    hours = checkpointed(stream.window_hours(failed, ["u1", "u2"], reports, now))
    return stream.split_late(own, lambda n: hours, lambda n: now, _folder(spark)).select("event_id", "source", "late")


def stream_links(spark, sf_dir):
    """Links of the pages' stream that the ledger of the days before doesn't have, each once."""
    own = table(spark, sf_dir, "pages")
    pages = streamed(spark, sf_dir, "pages")
    linked = lambda t: t.select(day_of("page_id").alias("day"), day_of("page_id").cast("timestamp").alias("pub_ts"), tx.canonical_url(F.col("url")).alias("url_norm"))
    ledger = linked(own).where("day < DATE'2024-01-16'")
    found = stream.fresh_links(linked(pages).where("day >= DATE'2024-01-16'"), ledger)
    return stream.drained(found.select("url_norm"), _folder(spark)).select("url_norm").distinct()


def stream_history(spark, sf_dir):
    """The history of reports after a stream of reported articles, each of which comes twice: by day, once, clipped, of the last seven days."""
    own = articles(spark, sf_dir).select("day", "article_id", (F.col("article_id") * 2).alias("pos"), "title")
    docs = streamed(spark, sf_dir, "documents")
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    new = docs.where("doc_id % 3 > 0").select(day_of("doc_id").alias("day"), F.col("doc_id").alias("article_id"), F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("pos"), title.alias("title"))
    update = lambda history, batch: sinks.upserted_days(history, batch.where("day >= DATE'2024-01-26'"), F.lit("2024-01-30").cast("date"), 7, {"title": 40})
    return stream.versioned(new, own, update, _folder(spark)).select("day", "article_id", "pos", "title")


_NAMES = [
    score_totals, daily_rank, rescued_rank, critique_scope, headlines, soft_gate, numbered_report, executive_set, rank_inversions, annotation_batches, top_signals, admitted_events, source_funnel,
    elimination_funnel, clean_streak, label_confusion, report_gaps, report_violations, report_decisions, corrected_scores, content_or_source, history_upsert, ledger_after_run,
    reconciled_body, overridden_report, fresh_supply, answers_to_rows, daily_digest, stream_funnel, stream_unseen,
    stream_weekly, stream_late, stream_links, stream_history,
]
QUERIES = {f.__name__: f for f in _NAMES}

_OK = "cyber_gate AND NOT dup_flag"
_SECTIONS = f"""
    {SCORES}, r AS (SELECT *, article_id % 7 = 0 AS recent, row_number() OVER (PARTITION BY day ORDER BY {ORDER}) AS rank FROM s WHERE {_OK}),
    p AS (SELECT *, rank AS pos, CASE WHEN headline_ok AND row_number() OVER (PARTITION BY day ORDER BY NOT headline_ok, rank) <= 3 THEN 'headline' ELSE 'body' END AS section FROM r)"""
_LAYERS = f"""
    {SCORES}, one AS (SELECT day, article_id, headline_ok, total, dup_flag, 1 AS layer_no, CASE WHEN total >= 60 THEN 'headline' ELSE 'body' END AS section, CAST(NULL AS VARCHAR) AS reason FROM s WHERE cyber_gate),
    l AS (SELECT * FROM one UNION ALL SELECT day, article_id, headline_ok, total, dup_flag, 2, CASE WHEN dup_flag OR article_id % 17 = 0 THEN 'dropped' WHEN total >= 50 THEN 'headline' ELSE 'body' END,
        CASE WHEN dup_flag THEN 'duplicate' END FROM one)"""
_N = "len(regexp_extract_all(src_body, '\\S+'))"
_URLS = _ARTICLES_SQL["canonical_urls"]
_DAY = f"DATE '{FIRST_DAY}' + CAST"

ORACLE_SQL = {
    "score_totals": f"WITH {SCORES} SELECT article_id, category, cyber_gate, dup_flag, strategic, impact, urgency, trust, total FROM s",
    "daily_rank": f"WITH {SCORES} SELECT day, article_id, total, row_number() OVER (PARTITION BY day ORDER BY {ORDER}) AS rank FROM s WHERE {_OK}",
    "rescued_rank": f"""
        WITH {SCORES}, t AS (SELECT *, CASE WHEN {_OK} AND NOT no_points AND total > 0 THEN 0 ELSE 1 END AS tier FROM s WHERE {_OK}),
        r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY tier, {ORDER}) AS rank FROM t) SELECT day, article_id, tier, rank FROM r WHERE tier = 0 OR rank <= 6""",
    "critique_scope": f"""
        WITH {SCORES}, z AS (SELECT *, cyber_gate AND total = 0 AS zero, row_number() OVER (PARTITION BY day ORDER BY total DESC, seq) AS k FROM s),
        y AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY NOT zero, strategic + impact + urgency + trust DESC, seq) AS j FROM z)
        SELECT day, article_id FROM y WHERE k <= 20 OR category = 'zafiyet_aktif_apt' OR (zero AND j <= 10)""",
    "headlines": f"""
        WITH {SCORES}, t AS (SELECT *, CASE WHEN headline_ok AND article_id % 7 <> 0 THEN 0 WHEN headline_ok THEN 1 WHEN is_vuln THEN 2 ELSE 3 END AS tier FROM s WHERE {_OK}),
        r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY tier, {ORDER}) AS slot FROM t) SELECT day, article_id, tier, slot FROM r WHERE slot <= 3""",
    "soft_gate": f"WITH {SCORES}, n AS (SELECT *, count(*) FILTER (total >= 60) OVER (PARTITION BY day) AS n FROM s) SELECT day, article_id FROM n WHERE total >= 60 OR n < 3",
    "numbered_report": f"""
        WITH {_SECTIONS}, n AS (SELECT *, count(*) FILTER (section = 'body' AND NOT is_vuln) OVER (PARTITION BY day) AS n,
            row_number() OVER (PARTITION BY day ORDER BY NOT (section = 'body' AND is_vuln), pos) AS v FROM p),
        m AS (SELECT *, CASE WHEN section = 'headline' THEN 'headline' WHEN NOT is_vuln OR v <= 5 - n THEN 'regular' ELSE 'vulnerability' END AS part FROM n)
        SELECT day, article_id, part, CASE WHEN part <> 'headline' THEN row_number() OVER (PARTITION BY day, part = 'headline' ORDER BY part = 'vulnerability', pos) END AS number FROM m""",
    "executive_set": f"""
        WITH {_SECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY day, section = 'body' AND rank <= 10 AND NOT is_vuln ORDER BY rank) AS k FROM p)
        SELECT day, article_id, section FROM k WHERE section = 'headline' OR (rank <= 10 AND NOT is_vuln AND k <= 6)""",
    "rank_inversions": f"""
        WITH {SCORES}, r AS (SELECT *, CASE WHEN article_id % 11 = 0 THEN 'headline' ELSE 'body' END AS section FROM s WHERE {_OK}),
        h AS (SELECT day, min(total) AS lowest FROM r WHERE section = 'headline' GROUP BY day),
        k AS (SELECT r.*, lowest, row_number() OVER (PARTITION BY day ORDER BY total DESC, seq) AS k FROM r JOIN h USING (day) WHERE section = 'body' AND headline_ok AND total > lowest)
        SELECT day, article_id, total, lowest FROM k WHERE k <= 5""",
    "annotation_batches": f"WITH {ARTICLES} SELECT article_id, (row_number() OVER (PARTITION BY day ORDER BY seq) - 1) // 5 AS batch FROM a",
    "top_signals": """
        WITH e AS (SELECT event_type AS platform, event_id AS id, round(value, 6) AS score FROM events WHERE value IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY score DESC, id) AS k FROM e)
        SELECT platform, id, score FROM k WHERE k <= CASE platform WHEN 'click' THEN 5 WHEN 'view' THEN 1 ELSE 1000000000 END ORDER BY score DESC, id LIMIT 12""",
    "admitted_events": f"SELECT event_id, event_type AS source FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '{NOW}' - CASE WHEN event_type IN ('purchase', 'signup') THEN INTERVAL 168 HOUR ELSE INTERVAL 96 HOUR END",
    "source_funnel": f"""
        WITH {ARTICLES}, f AS (SELECT source, count(*) AS raw, count(*) FILTER (article_id % 4 <> 0) AS kept, count(*) FILTER (article_id % 4 <> 0 AND {_N} >= 100) AS text_ok,
            count(*) FILTER (article_id % 4 <> 0 AND article_id % 3 = 0 AND {_N} >= 100) AS pool, count(*) FILTER (article_id % 5 = 0) AS seen FROM a GROUP BY source)
        SELECT source, raw, kept, text_ok, pool, CASE WHEN kept = 0 THEN 'window zero' WHEN text_ok = 0 THEN 'extraction zero' WHEN pool = 0 AND seen >= text_ok THEN 'already reported' WHEN pool = 0 THEN 'dedup zero' ELSE 'ok' END AS status FROM f""",
    "elimination_funnel": f"""
        WITH {SCORES}, r AS (SELECT *, total >= 40 AS reported, CASE WHEN total < 40 THEN CASE WHEN NOT cyber_gate THEN 'gate' WHEN dup_flag THEN 'duplicate' WHEN no_points THEN 'category' END END AS reason FROM s),
        d AS (SELECT day, string_agg(reason || '=' || n, ',' ORDER BY reason) AS by_reason FROM (SELECT day, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY day)
        SELECT day, count(*) AS candidates, count(*) FILTER (cyber_gate) AS cyber, count(*) FILTER (total > 0) AS scored, count(*) FILTER (reported) AS reported,
            count(*) FILTER (NOT reported AND reason IS NULL) AS unexplained, coalesce(any_value(by_reason), '') AS by_reason, count(*) FILTER (reported) < 12 AS thin FROM r LEFT JOIN d USING (day) GROUP BY day""",
    "clean_streak": f"WITH {ARTICLES}, d AS (SELECT DISTINCT day FROM a), l AS (SELECT max(day) AS last FROM d WHERE day(day) % 9 = 0) SELECT count(*) AS streak FROM d, l WHERE last IS NULL OR day > last",
    "label_confusion": f"WITH {ARTICLES} SELECT CASE WHEN quality = 1 THEN 'same' ELSE 'unrelated' END AS label, CASE WHEN {_N} >= 100 THEN 'same' ELSE 'unrelated' END AS predicted, count(*) AS n FROM a JOIN labels ON doc_id = article_id GROUP BY ALL",
    "report_gaps": """
        WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'purchase')
        SELECT user_id, day, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM d""",
    "report_violations": f"""
        WITH {_LAYERS} SELECT day, 2 AS layer_no, 'unexplained' AS kind, article_id FROM l WHERE layer_no = 2 AND section = 'dropped' AND reason IS NULL
        UNION ALL SELECT day, layer_no, 'category', article_id FROM l WHERE section = 'headline' AND NOT headline_ok
        UNION ALL SELECT day, layer_no, 'banned', article_id FROM l x WHERE section = 'headline' AND article_id % 13 = 0
            AND NOT EXISTS (SELECT 1 FROM l y WHERE y.article_id = x.article_id AND y.layer_no = x.layer_no - 1 AND y.section = 'headline')""",
    "report_decisions": f"WITH {_LAYERS} SELECT day, article_id, section, layer_no, reason FROM l WHERE layer_no = 2",
    "corrected_scores": f"""
        WITH {SCORES}, f AS (SELECT article_id, CASE WHEN article_id % 12 = 0 THEN 'siber_disi' ELSE 'veri_ihlali' END AS c2, cyber_gate AS g2, total + 1 AS t2 FROM s WHERE article_id % 6 = 0)
        SELECT s.article_id, coalesce(c2, category) AS category, cyber_gate, coalesce(t2, total) AS total, t2 IS NOT NULL AS changed
        FROM s LEFT JOIN (SELECT * FROM f WHERE NOT (c2 = 'siber_disi' AND g2)) f USING (article_id)""",
    "content_or_source": f"""
        WITH {ARTICLES} SELECT article_id, CASE WHEN article_id % 3 = 0 THEN reverse(title) ELSE title END AS out_title,
            CASE WHEN article_id % 3 = 0 THEN 'body' ELSE array_to_string(regexp_extract_all(src_body, '\\S+')[1:5], ' ') END AS out_body, article_id % 3 <> 0 AS is_fallback FROM a""",
    "history_upsert": f"""
        WITH {ARTICLES} SELECT day, article_id, title, md5(src_body) AS body FROM a WHERE day <> DATE '2024-01-30' AND day >= DATE '2024-01-23'
        UNION ALL SELECT DATE '2024-01-30', article_id, title[1:40], md5(src_body[1:60]) FROM a WHERE article_id % 10 = 0""",
    "ledger_after_run": f"""
        WITH u AS ({_URLS}), p AS (SELECT page_id, {_DAY}(page_id % 30 AS INTEGER) AS day, url_norm AS link FROM u)
        SELECT day, link, CASE WHEN day = DATE '2024-01-30' THEN 't ' || page_id ELSE ' t' || chr(9) || page_id END AS title FROM p WHERE day >= DATE '2024-01-23' AND (day < DATE '2024-01-30' OR link <> '')""",
    "reconciled_body": f"""
        WITH {_SECTIONS}, b AS (SELECT day, article_id, 1 AS t, pos FROM p WHERE section = 'body' AND article_id % 5 <> 1 UNION ALL SELECT day, article_id, 0, pos FROM p WHERE section = 'headline')
        SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY t, pos) AS pos FROM b""",
    "overridden_report": f"""
        WITH {_SECTIONS} SELECT day, section, CASE WHEN article_id % 9 = 1 THEN article_id + 1000000 ELSE article_id END AS article_id, row_number() OVER (PARTITION BY day, section ORDER BY pos) AS pos
        FROM p WHERE article_id % 9 <> 0""",
    "fresh_supply": f"""
        WITH {SCORES}, f AS (SELECT day, count(*) FILTER ({_OK}) AS fresh, count(*) FILTER (dup_flag) AS dups FROM s GROUP BY day)
        SELECT day, fresh, dups, CAST(greatest(4, least(10, round_even(0.45 * fresh, 0))) AS BIGINT) AS least FROM f""",
    "answers_to_rows": f"WITH {SCORES} SELECT article_id // {BATCH} AS batch, article_id, category FROM s WHERE article_id // {BATCH} % 8 < 6",
    "daily_digest": f"""
        WITH {SCORES}, {ARTICLES}, f AS (SELECT min(article_id) AS article_id FROM a GROUP BY regexp_replace(lower(title || src_body), '^\\s+|\\s+$', '', 'g')),
        r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {ORDER}) AS rank FROM s WHERE {_OK} AND total > 0 AND article_id IN (SELECT article_id FROM f))
        SELECT day, rank, article_id, category, total, headline_ok AND row_number() OVER (PARTITION BY day ORDER BY NOT headline_ok, rank) <= 3 AS is_headline FROM r""",
    "stream_funnel": "SELECT CAST(ts AS DATE) AS day, event_type AS source, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "stream_unseen": "SELECT DISTINCT user_id FROM events",
    "stream_weekly": "SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS day, event_type AS source, count(*) AS n, round(sum(value), 4) AS value FROM events, unnest(range(7)) AS u(k) WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_links": f"""
        WITH u AS ({_URLS}) SELECT DISTINCT url_norm FROM u WHERE page_id % 30 >= 15 AND url_norm <> '' AND url_norm NOT IN (SELECT url_norm FROM u WHERE page_id % 30 < 15)""",
    "stream_late": f"""
        WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND date_trunc('minute', ts) >= TIMESTAMP '2024-01-20 00:00:00' UNION SELECT unnest([1, 2]))
        SELECT event_id, 'u' || user_id AS source, coalesce(ts < TIMESTAMP '{NOW}' - CASE WHEN user_id IN (SELECT user_id FROM f) THEN INTERVAL 168 HOUR ELSE INTERVAL 96 HOUR END, false) AS late FROM events""",
    "stream_history": f"""
        WITH {ARTICLES} SELECT day, article_id, article_id * 2 AS pos, CASE WHEN day >= DATE '2024-01-26' AND article_id % 3 > 0 THEN title[1:40] ELSE title END AS title
        FROM a WHERE day >= DATE '2024-01-23' AND (day < DATE '2024-01-26' OR article_id % 3 > 0 OR day NOT IN (SELECT day FROM a WHERE article_id % 3 > 0))""",
}
