"""Queries on readers, state tables and single functions. Payloads are made from the driver's tables, row by row, and read back by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import lexicon as lx
from ..functions import predicates as pr
from ..functions import text as tx
from ..operators import ranking as rk
from ..operators import report as rp
from ..operators import select
from ..sources import feeds, histories, sinks
from .articles_plan import _TITLE as _STEMS
from .tables import ARTICLES, FIRST_DAY, SCORES, articles, day_of, joined, table

TODAY = "2024-01-30"
NEWSLETTER = ["newsletter", "weekly", "digest", "page-1"]


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_titles(spark, sf_dir):
    """Each article as a feed, an item for each of its lines: the first 40 that aren't blank."""
    lines = F.split("src_body", "\n", -1)
    item = lambda x, i: F.concat(F.lit("<item><title>"), _escaped(x), F.lit("</title><link>https://x/"), i.cast("string"), F.lit("</link></item>"))
    payload = F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), F.array_join(F.transform(lines, item), ""), F.when(F.col("article_id") % 2 == 0, "</channel></rss>").otherwise("<item><title>cut"))
    own = articles(spark, sf_dir).select(F.col("article_id").cast("string").alias("source"), payload.alias("payload"))
    return feeds.feed_items(own).select(F.col("source").cast("long").alias("article_id"), "title", "link")


def digest_rows(spark, sf_dir):
    """Articles written as digest blocks and read back."""
    block = F.concat(F.lit("=" * 60 + "\n["), F.col("article_id").cast("string"), F.lit("] "), "source", F.lit(" - "), "title", F.lit("\nTarih: "), F.col("day").cast("string"), F.lit("\nLink: https://x/"), F.col("article_id").cast("string"), F.lit("\n\nbody of "), F.col("article_id").cast("string"), F.lit("\n"))
    return feeds.digest_articles(articles(spark, sf_dir).select(block.alias("value"))).select("id", "source", "title", "date", "link", "body")


def _ledger_lines(spark, sf_dir):
    """A line for each page: three or four columns, tabs in some titles, some days that are none."""
    n = F.col("page_id")
    day = F.when(n % 13 == 0, "no day").otherwise(day_of("page_id").cast("string"))
    title = F.concat(F.lit("t"), F.when(n % 3 == 0, F.lit("\t")).otherwise(" "), n.cast("string"))
    return table(spark, sf_dir, "pages").select(n.alias("line_no"), F.concat_ws("\t", day, "url", title, F.when(n % 2 == 0, F.md5("url"))).alias("value"))


def seen_links(spark, sf_dir):
    return feeds.seen_links(_ledger_lines(spark, sf_dir), F.lit("2024-01-23").cast("date")).select("day", "link", "title", "content_hash")


def seen_titles(spark, sf_dir):
    """The last title of each link of the ledger."""
    found = feeds.seen_links(_ledger_lines(spark, sf_dir), F.lit("2024-01-23").cast("date"))
    return feeds.last_titles(found)


def failed_sources(spark, sf_dir):
    """Users as sources whose purchases are errors of the log."""
    line = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm"), F.lit(" | "), F.upper("event_type"), F.lit(" - u"), F.col("user_id").cast("string"), F.lit(": detail: more"))
    own = table(spark, sf_dir, "events").select(line.alias("value"))
    return feeds.failed_sources(own, F.lit("2024-01-20 00:00:00").cast("timestamp"), ["PURCHASE"])


def _stored(spark, sf_dir, keep):
    view = F.struct(F.when(F.col("article_id") % 5 > 0, F.col("title")).alias("tr_title"), F.lit("").alias("paragraph"), F.col("title").alias("title"), F.substring("src_body", 1, 30).alias("full_text"))
    own = articles(spark, sf_dir).where(keep).select("article_id", F.to_json(F.array(F.struct(F.col("day").cast("string").alias("date"), F.array(view, view).alias("views")))).alias("value"))
    return histories.history(own, F.lit(TODAY).cast("date"))


def stored_history(spark, sf_dir):
    return _stored(spark, sf_dir, F.lit(True)).select("day", "pos", "out_title", "src_title", "src_body")


def combined_history(spark, sf_dir):
    """Both histories in one, headlines first on each day."""
    a = articles(spark, sf_dir).select("day", F.col("article_id").alias("pos"), "title")
    return histories.both_histories(a.where("article_id % 10 = 0"), a.where("article_id % 10 > 0")).select("day", "pos", "is_headline", F.col("seq").cast("long").alias("seq"))


def archive_titles(spark, sf_dir):
    """The newest 160 titles of the last seven days of an archive before today."""
    blocks = articles(spark, sf_dir).where("title <> ''").select("day", F.col("article_id").alias("pos"), "title")
    return histories.archive_events(blocks, F.lit(TODAY).cast("date"), 7).select("day", "title")


def social_signals(spark, sf_dir):
    """Events as posts, stories and advisories of three platforms, an array of one each."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("i"), (F.col("event_id") % 3).alias("k"), (F.col("event_id") % 101).alias("n"), (F.col("event_id") % 7).alias("m"), "event_type")
    post = F.struct(F.col("i").alias("id"), F.concat(F.lit("<p>says #tag "), "event_type", F.lit(" https://x/y </p>")).alias("content"), F.col("n").alias("favourites_count"), F.col("m").alias("reblogs_count"), F.lit(2).alias("replies_count"))
    story = F.struct(F.col("i").alias("id"), F.col("event_type").alias("title"), F.col("n").alias("score"), F.col("m").alias("descendants"))
    advisory = F.struct(F.concat(F.lit("GHSA-"), "i").alias("ghsa_id"), F.col("event_type").alias("summary"), F.when(F.col("m") > 3, "High").otherwise("low").alias("severity"), F.struct((F.col("n") / 10).alias("score")).alias("cvss"))
    payload = F.when(F.col("k") == 0, F.to_json(F.array(post))).when(F.col("k") == 1, F.to_json(F.array(story))).otherwise(F.to_json(F.array(advisory)))
    platform = F.when(F.col("k") == 0, "mastodon").when(F.col("k") == 1, "hackernews").otherwise("advisory")
    return histories.social_signals(e.select(platform.alias("platform"), payload.alias("payload"))).select("platform", "native_id", "title", F.round("score", 4).alias("score"))


def social_admitted(spark, sf_dir):
    """Signals of a platform's least score, with text enough and none of the skipped words."""
    own = social_signals(spark, sf_dir)
    return pr.social_filter(own, {"mastodon": 50.0, "hackernews": 20.0}, 4, ["view"]).select("platform", "native_id")


def last_audits(spark, sf_dir):
    """The last line of each day of an audit log with a broken line for every eleventh article."""
    n = F.col("article_id")
    good = F.to_json(F.struct(F.col("day").cast("string").alias("tarih"), n.alias("n")))
    lines = articles(spark, sf_dir).select(n.alias("line_no"), F.when(n % 11 == 0, F.lit('{"tarih": ')).otherwise(good).alias("value"))
    return histories.last_audit(lines).select("day", F.get_json_object("record", "$.n").cast("long").alias("n"))


def case_merge(spark, sf_dir):
    """Cases with the new ones in place of those of the same name."""
    a = articles(spark, sf_dir)
    old = a.select(F.col("article_id").cast("string").alias("name"), F.lit("old").alias("label"))
    new = a.where("article_id % 3 = 0").select((F.col("article_id") * 2).cast("string").alias("name"), F.lit("new").alias("label"))
    return histories.golden_pairs(old, new)


def _cases(spark, sf_dir):
    """A case for each article: its own title's part, in capitals, against a part of its own title again or, for odd ids, of the title of the next article of its day, or against a raw id."""
    a = articles(spark, sf_dir)
    n, title = F.col("article_id"), F.col("title")
    part = F.when(n % 11 == 0, "").when(n % 9 == 0, F.concat(F.substring(title, 5, 12), F.lit("#none"))).when(n % 4 == 0, F.substring(title, 3, 2)).otherwise(F.translate(F.substring(title, 5, 24), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    other = a.select((n - 30).alias("article_id"), title.alias("next_title"))
    held = a.join(other, "article_id", "left").withColumn("odd", n % 2 == 1)
    return held.select(
        F.concat(F.col("day").cast("string"), F.lit(" case "), n.cast("string")).alias("name"), F.when(F.col("odd"), "unrelated").otherwise("same").alias("label"),
        F.lit(None).cast("long").alias("a_raw"), F.col("day").alias("a_day"), part.alias("a_part"),
        F.when(n % 3 == 0, n).alias("b_raw"), F.col("day").alias("b_day"), F.substring(F.when(F.col("odd"), F.col("next_title")).otherwise(title), 1, 30).alias("b_part"),
    )


def golden_views(spark, sf_dir):
    """Cases with both views found by parts of titles, or by ids of raw pools, which only every second day has."""
    a = articles(spark, sf_dir)
    views = a.select("day", F.col("article_id").alias("id"), "title")
    raw = a.where(F.dayofmonth("day") % 2 == 0).select("day", F.col("article_id").alias("raw_id"), F.col("article_id").alias("id"))
    return histories.golden_cases(_cases(spark, sf_dir), views, raw)


def golden_accuracy(spark, sf_dir):
    """Labels of the cases that could be built, against stems of titles: how many agree, and how many decisions do."""
    own = articles(spark, sf_dir)
    told = lambda c: own.select(F.col("article_id").alias(c), fp.title_stems(F.col("title")).alias(f"_{c}"))
    met = golden_views(spark, sf_dir).where("status = 'built'").join(told("a"), "a").join(told("b"), "b")
    same = fp.jaccard(F.col("_a"), F.col("_b")) >= 0.45
    return rp.accuracy(met.select("label", F.when(same, "same").otherwise("unrelated").alias("predicted")))


def raw_pool(spark, sf_dir):
    """Articles with words, numbered in order on each day."""
    a = articles(spark, sf_dir).withColumn("word_count", tx.word_count(F.col("src_body"))).withColumn("success", F.col("article_id") % 6 > 0)
    return sinks.pool(a, ["day"]).select("day", "article_id", F.col("number").cast("long").alias("number"))


def pending_links(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(day_of("page_id").alias("day"), F.when(F.col("page_id") % 9 > 0, F.col("url")).alias("link"), F.col("page_id").cast("string").alias("title"), F.lit("d").alias("description"))
    return sinks.staged(own, F.lit(TODAY).cast("date"))


def log_newest(spark, sf_dir):
    """The newest 5000 rows of the scores' log."""
    log = articles(spark, sf_dir).select("day", "article_id")
    return sinks.newest(log, 5000, [F.desc("day"), F.desc("article_id")])


def archive_appended(spark, sf_dir):
    """An archive after today's report: headlines first, then at most 43 body rows, unless today is there already."""
    a = articles(spark, sf_dir).select("day", "article_id", F.col("article_id").alias("pos"), (F.col("article_id") % 50 == 29).alias("is_headline"))
    return sinks.archived(a.where(F.col("day") < TODAY), a.where(F.col("day") == TODAY)).select("day", "article_id", F.col("number").cast("long").alias("number"))


def error_log(spark, sf_dir):
    """Errors of the last seven days, new ones with them."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return sinks.appended_log(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), F.lit("2024-01-25 00:00:00").cast("timestamp"), 7).select("event_id")


def reset_days(spark, sf_dir):
    a, p = articles(spark, sf_dir).select("day", F.col("article_id").alias("id")), table(spark, sf_dir, "pages").select(day_of("page_id").alias("day"), F.col("page_id").alias("id"))
    left = sinks.reset_day([a, p], F.lit(TODAY).cast("date"))
    return left[0].withColumn("of", F.lit("articles")).unionByName(left[1].withColumn("of", F.lit("pages"))).groupBy("of", "day").agg(F.count("*").alias("n"))


def kept_reports(spark, sf_dir):
    """Days whose report stays, as the new one is shorter: even ids are the old report, odd ones the new."""
    days = articles(spark, sf_dir).groupBy("day").agg(F.count_if(F.col("article_id") % 3 == 0).alias("old"), F.count_if(F.col("article_id") % 3 == 1).alias("new"))
    return days.select("day", sinks.kept_report(F.dayofmonth("day") % 2 == 0, F.col("old"), F.col("new")).alias("replaced"))


def retained_days(spark, sf_dir):
    """Days of reports of the last 20 days that are there."""
    return sinks.retained(articles(spark, sf_dir).where("article_id % 4 > 0").select("day"), F.lit(TODAY).cast("date"), 20)


def parsed_times(spark, sf_dir):
    """Events' times written in four forms and parsed, with the day that readers see."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    got = tx.timestamp_of(text)
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(got).alias("seconds"), tx.local_day(got).alias("shown"))


def shortened_titles(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", tx.shortened_title(F.trim(F.col("title")), [" the ", " de ", " der "]).alias("title"))


def corrected_years(spark, sf_dir):
    """Years of a generated text, on when an order's lines were sent, against those of its source, on when it was ordered and due."""
    sent = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(sent, F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    out = F.concat(F.lit("Sent from "), day("first"), F.lit(" to "), day("last"))
    src = F.concat(F.lit("Ordered on "), day("o_orderdate"), F.lit(", due on "), day(F.date_add("o_orderdate", 120)))
    return rows.select("o_orderkey", tx.corrected_year(out, src).alias("x")).select("o_orderkey", "x.text", "x.action")


def clean_pages(spark, sf_dir):
    """Whole pages, fenced, with bold marks around their paragraphs and in their style blocks, where they stay."""
    html = F.coalesce("html", F.lit(""))
    marked = F.replace(F.replace(F.replace(html, F.lit("<p>"), F.lit("<p>**")), F.lit("</p>"), F.lit("**</p>")), F.lit("<style>"), F.lit("<style>/**x**/"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(pr.without_markup(F.concat(F.lit("```html\n"), marked, F.lit("\n```")))).alias("page"))


def social_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pr.social_text(F.concat(F.lit("<b>"), F.coalesce("text", F.lit("")), F.lit("</b> see https://x.y/z #tag"))).alias("text"))


#: Words that stand for evaluative ones in the tables' texts.
_COMMENT = ["the", "and", "of", "in", "on", "er", "de", "der", "die", "und", "la", "el", "en", "que"]


def commentary_stripped(spark, sf_dir):
    """Whole texts without the last sentences that only comment."""
    body = tx.without_commentary(F.col("src_body"), _COMMENT)
    return articles(spark, sf_dir).select("article_id", F.md5(body).alias("body"), (F.length("src_body") - F.length(body)).cast("long").alias("n_cut"))


def flagged_ids(spark, sf_dir):
    """Ids that an annotator's list flags, of those that were asked."""
    a = articles(spark, sf_dir).select("day", "article_id")
    answers = a.select("day", F.to_json(F.array(F.col("article_id"), F.col("article_id") + 1, F.lit(-5))).alias("text"))
    return feeds.flags(answers.withColumnRenamed("day", "batch"), a.select(F.col("day").alias("batch"), "article_id")).select(F.col("batch").alias("day"), "article_id")


def unusable_answers(spark, sf_dir):
    """Answers that gave no row, by their outer shape: of each article a map, its lines' lengths, its title, no JSON, a map without ids, or a list of such."""
    n, title = F.col("article_id"), F.col("title")
    named = F.to_json(F.map_from_entries(F.array(F.struct(F.col("source").alias("k"), n.alias("v")), F.struct(F.coalesce("lang", F.lit("none")).alias("k"), n.alias("v")))))
    lengths = F.to_json(F.transform(F.slice(F.split("src_body", "\n", -1), 1, 5), lambda x: F.length(x)))
    good = F.concat(F.lit('{"'), n.cast("string"), F.lit('": '), F.to_json(F.struct(title.alias("tr_title"))), F.lit("}"))
    text = F.coalesce(*[F.when(n % 6 == k, v) for k, v in enumerate([good, lengths, F.concat(F.lit('"'), F.regexp_replace(title, r"[^\p{L} ]", ""), F.lit('"')), F.concat(F.lit("Sorry: "), title), named, F.concat(F.lit("["), named, F.lit("]"))])])
    return feeds.unusable(articles(spark, sf_dir).select(n.alias("batch"), text.alias("text")))


def term_signals(spark, sf_dir):
    """Which articles speak of a term, blame a state, and are vulnerabilities by category or title."""
    body, title = F.col("src_body"), F.col("title")
    terms = {"terms": ["wanes"], "countries": ["the", "der"], "links": ["tion"], "actors": ["heren"]}
    blamed = pr.attributed(body, **terms)
    category = F.when(F.col("article_id") % 3 == 0, "zafiyet_rutin").when(F.col("article_id") % 3 == 1, "phishing")
    vulnerable = pr.vulnerability(category, F.col("article_id") % 7 == 0, title, ["tion"], ["zafiyet_rutin"])
    return articles(spark, sf_dir).select("article_id", pr.any_of(body, ["tion", "ouer", "[x]"]).alias("has_term"), blamed.alias("is_blamed"), vulnerable.alias("is_vulnerability"))


def early_evidence(spark, sf_dir):
    """Whether a term stands in the first 60 words."""
    return articles(spark, sf_dir).select("article_id", pr.early(F.col("src_body"), ["tion", "ouer"]).alias("has_evidence"))


def newsletters(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pr.newsletter(F.col("url"), NEWSLETTER).alias("is_newsletter"))


def rerouted(spark, sf_dir):
    """What becomes of rows that an annotator would remove, and whether their rewrites are accepted."""
    a = articles(spark, sf_dir)
    new = F.substring("src_body", 1, 300)
    old = F.col("src_body")
    return a.select("article_id", pr.reroute(old, F.col("title")).alias("action"), pr.accepts_rewrite(old, new, F.array().cast("array<string>")).alias("accepted"), F.md5(pr.longer(F.col("title"), new)).alias("longer"))


def package_mentions(spark, sf_dir):
    """Words near a sign of a package ecosystem, in whole texts; the sign is put before every third article."""
    text = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("The npm package "), "src_body")).otherwise(F.col("src_body"))
    return articles(spark, sf_dir).select("article_id", joined(fp.package_names(text)).alias("packages"))


def bulletin_products(spark, sf_dir):
    text = F.concat(F.lit("Multiples vulnérabilités dans les "), F.regexp_replace("title", "[()]", ""), F.lit(" (2024)"))
    return articles(spark, sf_dir).select("article_id", joined(fp.bulletin_product(text)).alias("product"))


def capped_priorities(spark, sf_dir):
    from .reports_plan import scores

    return scores(spark, sf_dir).select("article_id", rk.effective_priority(F.col("priority"), F.col("article_id") % 2 == 0).cast("long").alias("priority"))


def strongest_relations(spark, sf_dir):
    """Of an article's relations to earlier ones of its source, the strongest; relations follow from equal texts and languages."""
    a = articles(spark, sf_dir).select("article_id", "source", "lang", F.md5("src_body").alias("h"))
    # The first of equal texts stands for all before an article, so copies aren't paired with one another.
    told = lambda c, relation: a.join(a.groupBy("h", c).agg(F.min("article_id").alias("first")), ["h", c]).where("first < article_id").select(F.col("article_id").alias("b"), F.lit(relation).alias("relation"))
    return select.strongest(told("source", "same").unionByName(told("lang", "new_development"))).select(F.col("id").alias("article_id"), "relation")


def placed_everywhere(spark, sf_dir):
    """Annotators' placements completed: unknown ids go, ids placed nowhere follow at the end."""
    a = articles(spark, sf_dir)
    placed = a.where("article_id % 2 = 0").select("day", (F.col("article_id") + F.when(F.col("article_id") % 10 == 0, 1_000_000).otherwise(0)).alias("article_id"), F.col("article_id").alias("pos"))
    return rp.completed(placed, a.select("day", "article_id", "seq"), ["day"]).select("day", "article_id", F.col("pos").cast("long").alias("pos"))


_NAMES = [
    feed_titles, digest_rows, seen_links, seen_titles, failed_sources, stored_history, combined_history, archive_titles, social_signals, social_admitted, last_audits, case_merge, golden_views, golden_accuracy, raw_pool, pending_links,
    log_newest, archive_appended, error_log, reset_days, kept_reports, retained_days, parsed_times, shortened_titles, corrected_years, clean_pages, social_texts, commentary_stripped, flagged_ids,
    unusable_answers, term_signals, early_evidence, newsletters, rerouted, package_mentions, bulletin_products, capped_priorities, strongest_relations, placed_everywhere,
]
QUERIES = {f.__name__: f for f in _NAMES}

_DAY = f"DATE '{FIRST_DAY}' + CAST"
_PAGE_DAY = f"{_DAY}(page_id % 30 AS INTEGER)"
_FILL = ", ".join(f"'{w}'" for w in lx.BULLETIN_FILL)
_W = "regexp_extract_all({}, '\\S+')"
_LINES = f"""
    l AS (SELECT page_id, CASE WHEN page_id % 13 > 0 THEN {_PAGE_DAY} END AS day, url AS link, 't' || CASE WHEN page_id % 3 = 0 THEN chr(9) ELSE ' ' END || page_id AS title,
        CASE WHEN page_id % 2 = 0 THEN md5(url) END AS content_hash FROM pages),
    k AS (SELECT * FROM l WHERE day >= DATE '2024-01-23')"""
_GOLDEN = f"""
    {ARTICLES}, c AS (SELECT CAST(a.day AS VARCHAR) || ' case ' || a.article_id AS name, a.day, a.article_id, CASE WHEN a.article_id % 2 = 1 THEN 'unrelated' ELSE 'same' END AS label,
        lower(CASE WHEN a.article_id % 11 = 0 THEN '' WHEN a.article_id % 9 = 0 THEN a.title[5:16] || '#none' WHEN a.article_id % 4 = 0 THEN a.title[3:4] ELSE a.title[5:28] END) AS a_part,
        lower(CASE WHEN a.article_id % 2 = 1 THEN n.title ELSE a.title END[1:30]) AS b_part FROM a LEFT JOIN a n ON n.article_id = a.article_id + 30),
    f AS (SELECT name, (SELECT min(article_id) FROM a WHERE a.day = c.day AND contains(lower(a.title), c.a_part)) AS a,
        (SELECT min(article_id) FROM a WHERE a.day = c.day AND contains(lower(a.title), c.b_part)) AS b FROM c),
    r AS (SELECT c.name, label, article_id % 3 = 0 AND day(c.day) % 2 = 1 AS off, f.a, CASE WHEN article_id % 3 = 0 THEN article_id ELSE f.b END AS b FROM c JOIN f USING (name)),
    s AS (SELECT *, CASE WHEN off THEN 'other day' WHEN a IS NULL OR b IS NULL THEN 'missing' ELSE 'built' END AS status FROM r),
    v AS (SELECT name, label, status, CASE WHEN status = 'built' THEN a END AS a, CASE WHEN status = 'built' THEN b END AS b FROM s)"""
_SOCIAL = """
    s AS (SELECT CASE event_id % 3 WHEN 0 THEN 'mastodon' WHEN 1 THEN 'hackernews' ELSE 'advisory' END AS platform, CASE WHEN event_id % 3 = 2 THEN 'GHSA-' ELSE '' END || event_id AS native_id,
        CASE WHEN event_id % 3 = 0 THEN 'says ' || event_type ELSE event_type END AS title,
        round(CASE event_id % 3 WHEN 0 THEN event_id % 101 + 2 * (event_id % 7) + 2 WHEN 1 THEN event_id % 101 + 3 * (event_id % 7) ELSE CASE WHEN event_id % 7 > 3 THEN 30.0 ELSE 10.0 END + (event_id % 101) / 10 END, 4) AS score FROM events)"""

ORACLE_SQL = {
    "feed_titles": f"""
        WITH {ARTICLES}, l AS (SELECT article_id, string_split(src_body, chr(10)) AS x FROM a), i AS (SELECT article_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM l), n AS (SELECT article_id, trim(t) AS title, i FROM i WHERE trim(t) <> ''),
        k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY i) AS k FROM n) SELECT article_id, title, 'https://x/' || i AS link FROM k WHERE k <= 40""",
    "digest_rows": f"WITH {ARTICLES} SELECT article_id AS id, source, trim(title) AS title, CAST(day AS VARCHAR) AS date, 'https://x/' || article_id AS link, 'body of ' || article_id AS body FROM a",
    "seen_links": f"WITH {_LINES} SELECT day, link, title, content_hash FROM k",
    "seen_titles": f"WITH {_LINES} SELECT link, arg_max(title, page_id) AS title FROM k GROUP BY link",
    "failed_sources": "SELECT DISTINCT 'u' || user_id AS source FROM events WHERE event_type = 'purchase' AND date_trunc('minute', ts) >= TIMESTAMP '2024-01-20 00:00:00'",
    "stored_history": f"""
        WITH {ARTICLES} SELECT day, p AS pos, title AS out_title, title AS src_title, src_body[1:30] AS src_body FROM a, unnest([0, 1]) AS u(p)
        WHERE day >= DATE '{TODAY}' - 7 AND day < DATE '{TODAY}' AND article_id % 5 > 0 AND title <> ''""",
    "combined_history": f"WITH {ARTICLES} SELECT day, article_id AS pos, article_id % 10 = 0 AS is_headline, row_number() OVER (PARTITION BY day ORDER BY article_id % 10 > 0, article_id) AS seq FROM a",
    "archive_titles": f"""
        WITH {ARTICLES}, d AS (SELECT DISTINCT day FROM a WHERE title <> '' AND day < DATE '{TODAY}' ORDER BY day DESC LIMIT 7),
        f AS (SELECT title, max(day) AS day, min(article_id) AS pos FROM a WHERE title <> '' AND day IN (SELECT day FROM d) GROUP BY title) SELECT day, title FROM f ORDER BY day DESC, pos, title LIMIT 160""",
    "social_signals": f"WITH {_SOCIAL} SELECT * FROM s",
    "social_admitted": f"WITH {_SOCIAL} SELECT platform, native_id FROM s WHERE score >= CASE platform WHEN 'mastodon' THEN 50 WHEN 'hackernews' THEN 20 ELSE 0 END AND length(title) >= 4 AND NOT contains(lower(title), 'view')",
    "last_audits": f"WITH {ARTICLES} SELECT day, max(article_id) AS n FROM a WHERE article_id % 11 > 0 GROUP BY day",
    "case_merge": f"""
        WITH {ARTICLES}, n AS (SELECT CAST(article_id * 2 AS VARCHAR) AS name, 'new' AS label FROM a WHERE article_id % 3 = 0)
        SELECT CAST(article_id AS VARCHAR) AS name, 'old' AS label FROM a WHERE CAST(article_id AS VARCHAR) NOT IN (SELECT name FROM n) UNION ALL SELECT * FROM n""",
    "golden_views": f"WITH {_GOLDEN} SELECT * FROM v",
    "golden_accuracy": f"""
        WITH {_GOLDEN}, t AS (SELECT article_id, {_STEMS} AS stems FROM a),
        p AS (SELECT label, CASE WHEN len(x.stems) > 0 AND len(y.stems) > 0 AND len(list_intersect(x.stems, y.stems)) / len(list_distinct(x.stems || y.stems)) >= 0.45 THEN 'same' ELSE 'unrelated' END AS predicted
            FROM v JOIN t x ON x.article_id = v.a JOIN t y ON y.article_id = v.b WHERE status = 'built')
        SELECT count(*) AS n, count_if(label = predicted) AS label_ok, count_if((label = 'same') = (predicted = 'same')) AS policy_ok FROM p""",
    "raw_pool": f"WITH {ARTICLES} SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY article_id) AS number FROM a WHERE article_id % 6 > 0 AND len({_W.format('src_body')}) > 0",
    "pending_links": f"SELECT {_PAGE_DAY} AS day, url AS link, CAST(page_id AS VARCHAR) AS title, 'd' AS description FROM pages WHERE {_PAGE_DAY} = DATE '{TODAY}' AND page_id % 9 > 0 AND url <> ''",
    "log_newest": f"WITH {ARTICLES} SELECT day, article_id FROM a ORDER BY day DESC, article_id DESC LIMIT 5000",
    "archive_appended": f"""
        WITH {ARTICLES}, h AS (SELECT *, article_id % 50 = 29 AS head FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY day, head ORDER BY article_id) AS k FROM h)
        SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY NOT head, article_id) AS number FROM k WHERE head OR k <= 43""",
    "error_log": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'",
    "reset_days": f"""
        WITH x AS (SELECT 'articles' AS of, {_DAY}(doc_id % 30 AS INTEGER) AS day FROM documents UNION ALL SELECT 'pages', {_PAGE_DAY} FROM pages) SELECT of, day, count(*) AS n FROM x WHERE day <> DATE '{TODAY}' GROUP BY ALL""",
    "kept_reports": f"""
        WITH {ARTICLES}, d AS (SELECT day, count(*) FILTER (article_id % 3 = 0) AS old, count(*) FILTER (article_id % 3 = 1) AS new FROM a GROUP BY day) SELECT day, NOT (day(day) % 2 = 0 AND old > new) AS replaced FROM d""",
    "retained_days": f"WITH {ARTICLES} SELECT DISTINCT day FROM a WHERE article_id % 4 > 0 AND day > DATE '{TODAY}' - 20 AND day <= DATE '{TODAY}'",
    "parsed_times": """
        WITH e AS (SELECT event_id, CASE WHEN event_id % 4 < 3 THEN date_trunc('second', ts) END AS t FROM events) SELECT event_id, CAST(epoch(t) AS BIGINT) AS seconds, strftime(t + INTERVAL 3 HOUR, '%d.%m.%Y') AS shown FROM e""",
    "shortened_titles": f"""
        WITH {ARTICLES}, t0 AS (SELECT article_id, trim(title) AS t FROM a), t1 AS (SELECT article_id, CASE WHEN len({_W.format('t')}) > 8 THEN trim(regexp_replace(replace(t, ' the ', ' '), ' +', ' ', 'g')) ELSE t END AS t FROM t0),
        t2 AS (SELECT article_id, CASE WHEN len({_W.format('t')}) > 8 THEN trim(regexp_replace(replace(t, ' de ', ' '), ' +', ' ', 'g')) ELSE t END AS t FROM t1)
        SELECT article_id, CASE WHEN len({_W.format('t')}) > 8 THEN trim(regexp_replace(replace(t, ' der ', ' '), ' +', ' ', 'g')) ELSE t END AS title FROM t2""",
    "corrected_years": """
        WITH l AS (SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS s, strftime(max(l_shipdate), '%Y-%m-%d') AS r FROM lineitem GROUP BY l_orderkey),
        x AS (SELECT o_orderkey, s, r, CAST(year(o_orderdate) AS VARCHAR) AS p, CAST(year(o_orderdate + INTERVAL 120 DAY) AS VARCHAR) AS q FROM orders JOIN l ON l_orderkey = o_orderkey),
        y AS (SELECT *, s[1:4] NOT IN (p, q) AS so, r[1:4] NOT IN (p, q) AS ro FROM x)
        SELECT o_orderkey, 'Sent from ' || CASE WHEN so AND p = q THEN p || s[5:] ELSE s END || ' to ' || CASE WHEN ro AND p = q THEN p || r[5:] ELSE r END AS text,
            CASE WHEN NOT so AND NOT ro THEN 'ok' WHEN p = q THEN 'replaced' ELSE 'flagged' END AS action FROM y""",
    "clean_pages": r"""
        WITH m AS (SELECT page_id, string_split('```html' || chr(10) || replace(replace(replace(coalesce(html, ''), '<p>', '<p>**'), '</p>', '**</p>'), '<style>', '<style>/**x**/') || chr(10) || '```', '<style') AS x FROM pages)
        SELECT page_id, md5(regexp_replace(x[1], '```\w*|\*\*', '', 'g') || array_to_string(list_transform(x[2:], lambda s: '<style' || CASE WHEN contains(s, '</style>')
            THEN s[:strpos(s, '</style>') + 7] || regexp_replace(s[strpos(s, '</style>') + 8:], '```\w*|\*\*', '', 'g') ELSE s END), '')) AS page FROM m""",
    "social_texts": r"""
        SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<b>' || coalesce(text, '') || '</b> see https://x.y/z #tag', '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '#\S+', ' ', 'g'), '\s+', ' ', 'g'))[1:200] AS text FROM conversations""",
    "commentary_stripped": rf"""
        WITH {ARTICLES}, b AS (SELECT article_id, src_body, regexp_replace(src_body, '(^|[.!?…])(?:\s*(?:[^.!?…]*[^.!?…\p{{L}}\p{{M}}\p{{N}}_])?(?i:{"|".join(_COMMENT)})[.!?…]+\s*)+$', '\1') AS bare FROM a),
        c AS (SELECT *, CASE WHEN trim(bare) = '' THEN src_body ELSE regexp_replace(bare, '\s+$', '') END AS body FROM b)
        SELECT article_id, md5(body) AS body, length(src_body) - length(body) AS n_cut FROM c""",
    "flagged_ids": f"WITH {ARTICLES} SELECT day, article_id FROM a",
    "unusable_answers": f"""
        WITH {ARTICLES}, k AS (SELECT *, CASE WHEN source < coalesce(lang, 'none') THEN source || ',' || coalesce(lang, 'none') ELSE coalesce(lang, 'none') || ',' || source END AS names FROM a WHERE article_id % 6 > 0)
        SELECT CASE article_id % 6 WHEN 1 THEN 'array ' || least(5, len(string_split(src_body, chr(10)))) || ' of number' WHEN 2 THEN 'string' WHEN 3 THEN 'none' WHEN 4 THEN 'object ' || names ELSE 'array 1 of object ' || names END AS shape, count(*) AS n
        FROM k GROUP BY ALL""",
    "term_signals": f"""
        WITH {ARTICLES} SELECT article_id, regexp_matches(lower(src_body), 'tion|ouer|\\[x\\]') AS has_term,
            contains(lower(src_body), 'wanes') OR regexp_matches(src_body, '(?is)(the|der).{{0,60}}(tion|heren)|(tion|heren).{{0,60}}(the|der)') AS is_blamed,
            article_id % 7 > 0 AND CASE article_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE regexp_matches(title, '(?i)\\bCVE-[0-9]{{4}}-[0-9]{{4,7}}\\b') OR contains(lower(title), 'tion') END AS is_vulnerability FROM a""",
    "early_evidence": f"WITH {ARTICLES} SELECT article_id, regexp_matches(lower(array_to_string({_W.format('src_body')}[1:60], ' ')), 'tion|ouer') AS has_evidence FROM a",
    "newsletters": "SELECT page_id, regexp_matches(lower(url), 'newsletter|weekly|digest|page-1') AS is_newsletter FROM pages",
    "rerouted": f"""
        WITH {ARTICLES}, n AS (SELECT *, len({_W.format('src_body')}) AS ns, len({_W.format('title')}) AS nt, src_body[1:300] AS new, len({_W.format('src_body[1:300]')}) AS nn FROM a)
        SELECT article_id, CASE WHEN ns > 80 AND (nt < 50 OR len(list_filter({_W.format('title')}[1:30], lambda w: regexp_matches(w, '^[A-Za-z]+$'))) > 15) THEN 'regenerate' ELSE 'remove' END AS action,
            nn >= greatest(15.0, 0.55 * ns) AS accepted, md5(CASE WHEN nn > nt THEN new ELSE title END) AS longer FROM n""",
    "bulletin_products": f"""
        WITH {ARTICLES}, t AS (SELECT article_id, regexp_extract_all(lower('les ' || regexp_replace(title, '[()]', '', 'g')), '[0-9a-zà-ÿ]+') AS t FROM a)
        SELECT article_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(t, lambda w: length(w) >= 3 AND NOT list_contains([{_FILL}], w)), lambda w: w[1:5]))), ',') AS product FROM t""",
    "capped_priorities": f"WITH {SCORES} SELECT article_id, CASE WHEN article_id % 2 = 0 THEN priority ELSE least(4, priority) END AS priority FROM s",
    "strongest_relations": f"""
        WITH {ARTICLES}, h AS (SELECT article_id, source, lang, md5(src_body) AS h FROM a), p AS (SELECT y.article_id, CASE WHEN x.source = y.source THEN 0 WHEN x.lang = y.lang THEN 1 END AS r FROM h y JOIN h x ON x.h = y.h AND x.article_id < y.article_id)
        SELECT article_id, CASE min(r) WHEN 0 THEN 'same' ELSE 'new_development' END AS relation FROM p WHERE r IS NOT NULL GROUP BY article_id""",
    "placed_everywhere": f"""
        WITH {ARTICLES} SELECT day, article_id, row_number() OVER (PARTITION BY day ORDER BY article_id % 2 = 1 OR article_id % 10 = 0, article_id) AS pos FROM a""",
}
