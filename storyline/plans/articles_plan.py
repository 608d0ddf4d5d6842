"""Queries on articles and pages: text functions, fingerprints, candidate pairs, selection, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions import predicates as pr
from ..operators import select
from ..operators.base import checkpointed
from ..operators.runfilter import run_filter
from ..operators.pairs import set_classes, similar_sets
from ..operators.titles import similar_titles
from ..sources import pages as pg
from .tables import ARTICLES, articles, joined, table

TURKISH = "çğıöşüÇĞİÖŞÜ"


def _text(name, **columns):
    """A query that computes columns of each article."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return articles(spark, sf_dir).select("article_id", *[make().alias(c) for c, make in columns.items()])

    query.__name__ = name
    return query


def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url_norm"), tx.host(F.col("url")).alias("domain"), tx.safe_link(F.col("url")).alias("link"))


def unseen_articles(spark, sf_dir):
    """Articles of the last day whose content the seven days before don't have."""
    own = articles(spark, sf_dir).withColumn("content_hash", tx.content_hash(F.col("title"), F.col("lang")))
    today = own.where("day = DATE'2024-01-30'")
    seen = own.where("day >= DATE'2024-01-23' AND day < DATE'2024-01-30'").select("content_hash")
    return today.join(seen, "content_hash", "left_anti").select("article_id", "content_hash")


def _title_classes(spark, sf_dir):
    """(id, rep, tokens) of every article: those of equal stems of titles are a class; without stems each is its own."""
    return checkpointed(set_classes(articles(spark, sf_dir).select(F.col("article_id").alias("id"), fp.title_stems(F.col("title")).alias("tokens")), empty=True))


def _same_titles(classes: DataFrame) -> DataFrame:
    """(a, b, overlap): pairs of classes whose titles have similar stems."""
    return checkpointed(similar_sets(classes.where(F.size("tokens") > 0), 0.45))


def title_classes(spark, sf_dir):
    return _title_classes(spark, sf_dir).select(F.col("id").alias("article_id"), F.col("rep").alias("representative"))


def similar_title_stems(spark, sf_dir):
    """Pairs of classes of articles with similar titles; title_classes has their members."""
    return _same_titles(_title_classes(spark, sf_dir)).select("a", "b", F.round("overlap", 6).alias("overlap"))


def first_wins_titles(spark, sf_dir):
    """Run filter: articles in order, each dropped if an accepted earlier one has a similar title."""
    classes = _title_classes(spark, sf_dir)
    return select.first_of_classes(classes, _same_titles(classes)).where("accepted").select(F.col("id").alias("article_id"))


def same_code_names(spark, sf_dir):
    """Articles of a day whose title has a code name that an earlier one's has."""
    named = articles(spark, sf_dir).select("article_id", "day", F.explode(fp.codenames(F.col("src_body"))).alias("code"))
    first = named.groupBy("day", "code").agg(F.min("article_id").alias("first"))
    return named.join(first, ["day", "code"]).where("article_id <> first").groupBy("article_id").agg(F.min("first").alias("first"))


def generic_stems(spark, sf_dir):
    each = articles(spark, sf_dir).select("article_id", F.explode(fp.keywords(F.col("src_body"))).alias("stem"))
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return each.groupBy("stem").agg(F.count("*").alias("df")).join(F.broadcast(n)).where(f"df > {lx.GENERIC_SHARE} * n").select("stem", "df")


def similar_titles_072(spark, sf_dir):
    return similar_titles(articles(spark, sf_dir).select(F.col("article_id").alias("id"), "title"), 0.72)


def page_texts(spark, sf_dir):
    return pg.main_text(pg.page_parts(table(spark, sf_dir, "pages")))


def page_links(spark, sf_dir):
    """Links of pages as digests: before each page's own HTML come a story, the same again, an issue of the digest and one with a short text."""
    link = lambda to, *text: F.concat(F.lit(f'<li><a href="{to}'), F.col("page_id").cast("string"), F.lit('">'), *text, F.lit("</a></li>"))
    named = lambda to, text: link(to, F.lit(f"{text} "), F.col("page_id").cast("string"))
    # The short text has no id, which would make it longer on later pages.
    items = named("/story/1000", "All about story"), named("/story/1000", "Read more about it:"), named("/digest/1000", "All about issue"), link("/brief/1000", F.lit("In brief"))
    return pg.expanded_links(pg.page_parts(table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<ul>"), *items, F.lit("</ul>"), F.coalesce("html", F.lit(""))))))


def page_yield(spark, sf_dir):
    """Words of a page's main text by strategy."""
    return page_texts(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("n_words").alias("avg_words"), F.max("n_words").alias("max_words"))


def extractor_yield(spark, sf_dir):
    """What each strategy finds on the pages of each source; selectors by kind of host: some that no page has, some that hold no text, and one that does."""
    pages = table(spark, sf_dir, "pages")
    kind = lambda *x: F.struct(*[(F.lit(v).cast("string") if k else F.lit(v)).alias(c) for k, (v, c) in enumerate(zip(x, ("rank", "name", "class", "id"), strict=True))])
    blogs, mobiles = F.array(kind(0, None, "entry-content", None), kind(1, "article", None, None)), F.array(kind(0, "div", "ad", None), kind(1, None, None, "main"))
    source = tx.host(F.col("url"))
    catalogue = pages.select(source.alias("source")).distinct().select("source", F.explode(F.when(F.col("source").startswith("blog."), blogs).when(F.col("source").startswith("m."), mobiles)).alias("x"))
    return pg.extractor_yield(pg.page_parts(pages, catalogue.select("source", "x.*")), source).withColumn("avg_words", F.round("avg_words", 6))


def edited_pages(spark, sf_dir):
    """Texts of pages as an editor adds them by hand."""
    return pg.edited_text(pg.page_parts(table(spark, sf_dir, "pages"))).select("page_id", "strategy", "n_words", F.md5("text").alias("text"))


def title_clusters(spark, sf_dir):
    """Each article joins the first representative with a similar title."""
    classes = _title_classes(spark, sf_dir)
    reps = classes.where("id = rep").select("id")
    found = select.clusters(reps, _same_titles(classes).select("a", "b")).select(F.col("id").alias("_c"), F.col("rep").alias("representative"))
    return classes.join(found, F.col("rep") == F.col("_c")).select(F.col("id").alias("article_id"), "representative")


def distinct_picks(spark, sf_dir):
    """The first 50 articles in order that aren't excluded and tell nothing that an earlier pick does."""
    classes = _title_classes(spark, sf_dir)
    decided = select.first_of_classes(classes.where("id % 4 <> 1"), _same_titles(classes))
    return decided.where("accepted").orderBy("id").limit(50).select(F.col("id").alias("article_id"))


def new_against_history(spark, sf_dir):
    """Articles with an odd id that repeat neither an even one nor an earlier odd one."""
    classes = _title_classes(spark, sf_dir)
    pairs = _same_titles(classes)
    old = classes.where("id % 2 = 0").select(F.col("rep").alias("to")).distinct()
    told = select.class_links(classes, pairs).join(old, "to", "left_semi").select("rep").distinct()
    return select.first_of_classes(classes.where("id % 2 = 1").join(told, "rep", "left_anti"), pairs).where("accepted").select(F.col("id").alias("article_id"))


def restored_orphans(spark, sf_dir):
    """Of the dropped articles (ids not divisible by three), those that had a twin among the dropped and that nothing kept or taken back tells of."""
    classes = _title_classes(spark, sf_dir)
    pairs = _same_titles(classes)
    links = select.class_links(classes, pairs)
    kept = classes.where("id % 3 = 0").select(F.col("rep").alias("to")).distinct()
    told = links.join(kept, "to", "left_semi").select("rep").distinct()
    dropped = classes.where("id % 3 > 0")
    n = dropped.groupBy(F.col("rep").alias("to")).agg(F.count("*").alias("n"))
    twins = links.join(n, "to").groupBy("rep").agg(F.sum("n").alias("n")).where("n > 1").select("rep")
    orphans = dropped.join(told, "rep", "left_anti").join(twins, "rep", "left_semi")
    return select.first_of_classes(orphans, pairs).where("accepted").select(F.col("id").alias("article_id"))


def group_removals(spark, sf_dir):
    a = articles(spark, sf_dir)
    groups = a.select(F.md5("title").alias("group"), F.col("article_id").alias("id"), (F.col("article_id") % 10 == 0).alias("protected"), tx.word_count(F.col("src_body")).alias("n_source"), F.length("src_body").alias("n_text"))
    return select.group_removals(groups).select(F.col("id").alias("article_id"))


def related_passages(spark, sf_dir):
    """For each passage of the benchmark, the six articles with the most similar titles' stems; passages as titles."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), fp.keywords(F.col("text")).alias("tokens"))
    history = articles(spark, sf_dir).select(F.col("article_id").alias("id"), fp.keywords(F.col("src_body")).alias("tokens"))
    return select.related(items, history).select("id", "other", F.round("overlap", 6).alias("overlap"))


def body_origins(spark, sf_dir):
    own = articles(spark, sf_dir).withColumn("x", pr.body_origin(F.when(F.col("article_id") % 3 > 0, F.col("src_body")), F.concat("title", F.lit(" "), F.col("src_body"))))
    return own.select("article_id", F.col("x.origin").alias("origin"), F.md5(F.coalesce("x.text", F.lit(""))).alias("text"))


def repair_actions(spark, sf_dir):
    """Bodies, every second of which breaks off; the title is all there is to write them anew from."""
    a = articles(spark, sf_dir).withColumn("body", F.concat("src_body", F.when(F.col("article_id") % 2 == 0, " and").otherwise("")))
    action = pr.repair(tx.truncated(F.col("body")), tx.last_full_sentence(F.col("body")), F.col("title"), F.col("body"), F.col("article_id") % 9 == 0)
    return a.select("article_id", action.alias("action"), pr.needs_longer(F.col("body"), F.col("src_body")).alias("needs_longer"))


def source_windows(spark, sf_dir):
    """Events in their source's effective window."""
    own = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).cast("string").alias("source"), F.col("ts").cast("timestamp").alias("pub_ts"))
    return pr.effective_hours(own, F.lit("2024-01-25 00:00:00").cast("timestamp"), ["3", "7"]).select("event_id", F.col("hours").cast("long").alias("hours"))


def daily_briefs(spark, sf_dir):
    return pr.brief(articles(spark, sf_dir).select("day", F.col("seq").alias("pos"), "title"), ["day"], "Today: ")


def _run_items(spark, sf_dir):
    """Articles as items of the run filter, the last week's against all before; ids of history come first. A source's copies share a link."""
    own = articles(spark, sf_dir).withColumn("in_history", F.col("day") < F.lit("2024-01-24").cast("date"))
    return own.select(
        F.when(F.col("in_history"), F.col("article_id")).otherwise(F.col("article_id") + (1 << 40)).alias("id"), F.concat(F.lit("https://"), "source", F.lit("/"), F.md5("src_body")).alias("url"),
        tx.content_hash(F.col("title"), F.col("lang")).alias("content_hash"), "title", "in_history", "source", (tx.word_count(F.col("src_body")) > 0).alias("has_text"),
    )


def filtered(spark, sf_dir):
    """(article_id, accepted, level) of the last week's articles, run against all before."""
    return run_filter(_run_items(spark, sf_dir)).select((F.col("id") - (1 << 40)).alias("article_id"), "accepted", F.col("level").cast("long").alias("level"))


def run_filter_levels(spark, sf_dir):
    """The five-level filter over a week's articles against all those of the days before."""
    return filtered(spark, sf_dir)


def dedup_counts(spark, sf_dir):
    """Articles of the week by source and the level of the run filter that drops them."""
    level = F.get(F.array(*[F.lit(x) for x in ("link", "hash", "title", "stems", "code")]), F.col("level").cast("int") - 1)
    own = articles(spark, sf_dir).join(filtered(spark, sf_dir), "article_id").withColumn("level", level)
    return own.groupBy("source").pivot("level", ["link", "hash", "title", "stems", "code"]).count().na.fill(0)


def isolated_loss(spark, sf_dir):
    """By source, each a run of its own: articles, those of the week, those of them with a text, and what of these the run filter accepts and drops by level."""
    items = _run_items(spark, sf_dir)
    counts = items.groupBy("source").agg(F.count("*").alias("n_raw"), F.count_if(~F.col("in_history")).alias("n_window"), F.count_if(~F.col("in_history") & F.col("has_text")).alias("n_text"))
    asked = items.where("in_history OR has_text")
    run = asked.where("NOT in_history").select("id", "source").join(run_filter(asked, ("source",)), "id")
    dropped = [F.count_if(F.col("level") == k).alias(f"n_{name}") for k, name in enumerate(("link", "hash", "title", "stems", "code"), 1)]
    loss = run.groupBy("source").agg(F.count_if("accepted").alias("n_pool"), *dropped).withColumnRenamed("source", "_s")
    joined_ = counts.join(loss, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return joined_.na.fill(0, [c for c in joined_.columns if c.startswith("n_")])


QUERIES = {
    "isolated_loss": isolated_loss,
    "run_filter_levels": run_filter_levels,
    "dedup_counts": dedup_counts,
    "title_classes": title_classes,
    "title_clusters": title_clusters,
    "distinct_picks": distinct_picks,
    "new_against_history": new_against_history,
    "restored_orphans": restored_orphans,
    "group_removals": group_removals,
    "related_passages": related_passages,
    "body_origins": body_origins,
    "repair_actions": repair_actions,
    "source_windows": source_windows,
    "daily_briefs": daily_briefs,
    "canonical_urls": canonical_urls,
    "content_hashes": _text("content_hashes", content_hash=lambda: tx.content_hash(F.col("title"), F.col("lang"))),
    "word_counts": _text("word_counts", n_words=lambda: tx.word_count(F.col("src_body")).cast("long"), lead=lambda: tx.first_words(F.col("src_body"), 60)),
    "full_sentences": _text("full_sentences", cut=lambda: F.md5(tx.last_full_sentence(F.col("src_body"))), is_truncated=lambda: tx.truncated(F.col("src_body"))),
    "keyword_stems": _text("keyword_stems", stems=lambda: joined(fp.keywords(F.col("src_body"))), lead=lambda: joined(fp.keywords(F.col("src_body"), 40))),
    "code_names": _text("code_names", codes=lambda: joined(fp.codenames(F.col("src_body")))),
    "fact_tokens": _text("fact_tokens", facts=lambda: F.array_join(tx.fact_tokens(F.col("src_body")), ",")),
    "foreign_texts": _text("foreign_texts", is_foreign=lambda: tx.mostly_foreign(F.col("src_body"), TURKISH)),
    "title_stems": _text("title_stems", stems=lambda: joined(fp.title_stems(F.col("title")))),
    "entities": _text("entities", certain=lambda: joined(fp.entities(F.col("src_body"))["certain"]), candidate=lambda: joined(fp.entities(F.col("src_body"))["candidate"])),
    "actors": _text("actors", actors=lambda: joined(fp.actors(F.col("src_body"), lx.Lexicon(named_actors=("tion", "ouer", "schen"))))),
    "unseen_articles": unseen_articles,
    "similar_title_stems": similar_title_stems,
    "first_wins_titles": first_wins_titles,
    "same_code_names": same_code_names,
    "generic_stems": generic_stems,
    "similar_titles": similar_titles_072,
    "page_texts": page_texts,
    "page_links": page_links,
    "page_yield": page_yield,
    "extractor_yield": extractor_yield,
    "edited_pages": edited_pages,
}

_q = lambda names: ", ".join("'" + x.replace("'", "''") + "'" for x in names)
_KEY = f"regexp_replace(lower(src_body), '{lx.ACTOR_ID}', ' ', 'g')"
_STEMS = f"list_transform(list_filter(regexp_extract_all({_KEY}, '{fp.TOKEN}'), lambda t: length(t) >= 4 AND NOT list_contains([{_q(lx.STOP_WORDS)}], t)), lambda t: t[1:5])"
_FIRST = "list_transform(list_filter(list_transform(x, lambda t, i: {'t': t, 'i': i}), lambda s: list_position(x, s.t) = s.i), lambda s: s.t)"
_TITLE = "list_distinct(list_transform(list_filter(regexp_extract_all(lower(title), '\\S+'), lambda w: length(w) >= 5), lambda w: w[1:5]))"
_CODES = (
    "list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(regexp_replace(src_body, '" + lx.ADVISORY_ID + "', ' ', 'g'), '[A-Za-z][A-Za-z0-9]+'),"
    " lambda w: length(w) >= 5 AND (regexp_matches(w, '[a-z][A-Z]') OR regexp_matches(w, '^[A-Z]+$'))), lambda w: lower(w)),"
    f" lambda w: NOT list_contains([{_q(lx.CODENAME_DENY + lx.ACRONYM_DENY)}], w) AND NOT regexp_matches(w, '^[a-z]{{1,4}}aas$') AND length(replace(w, w[1:1], '')) > 0))"
)
_CLASSES = (
    f"c0 AS (SELECT article_id AS id, list_sort({_TITLE}) AS toks FROM a), c AS (SELECT min(id) AS id, toks FROM c0 WHERE len(toks) > 0 GROUP BY toks),"
    " t AS (SELECT id, unnest(toks) AS t FROM c), m AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY ALL),"
    " ce AS (SELECT a, b, k / (len(p.toks) + len(q.toks) - k) AS overlap FROM m JOIN c p ON p.id = a JOIN c q ON q.id = b WHERE k / (len(p.toks) + len(q.toks) - k) >= 0.45),"
    " mem AS (SELECT c0.id, c.id AS rep FROM c0 JOIN c USING (toks)),"
    " e AS (SELECT x.id AS a, y.id AS b FROM mem x JOIN mem y ON x.rep = y.rep AND x.id < y.id UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM ce JOIN mem x ON x.rep = ce.a JOIN mem y ON y.rep = ce.b)"
)

_WALK = """w(k, acc) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
            SELECT w.k + 1, CASE WHEN list_has_any(coalesce(adj.earlier, []), w.acc) THEN w.acc ELSE list_append(w.acc, n.id) END FROM w JOIN n ON n.k = w.k + 1 LEFT JOIN adj ON adj.id = n.id),
        p AS (SELECT unnest(acc) AS id FROM w WHERE k = (SELECT coalesce(max(k), 0) FROM n))"""
_ADJ = "adj AS (SELECT b AS id, list(a) AS earlier FROM e GROUP BY b)"
_BOTH = "z AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"

#: On the given pages, all blocks with enough text are headings and paragraphs of the only article; a paragraph ends where the next one starts.
_BLOCKS = r"""
    h AS (SELECT page_id, replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') AS source, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages),
    x AS (SELECT page_id, unnest(string_split_regex(body, '<p>|<h1>')[2:]) AS t, generate_subscripts(string_split_regex(body, '<p>|<h1>')[2:], 1) AS i FROM h),
    b AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)</(p|h1)>.*', ''), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM x)"""
_MAIN = rf"""
    a AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM b WHERE len(t) > 20 AND NOT regexp_matches(t, '{pg.NOT_TEXT}') GROUP BY page_id),
    m AS (SELECT page_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) AS n_words FROM h LEFT JOIN a USING (page_id))"""
ORACLE_SQL = {
    "title_classes": f"WITH {ARTICLES}, {_CLASSES} SELECT c0.id AS article_id, coalesce(rep, c0.id) AS representative FROM c0 LEFT JOIN mem ON mem.id = c0.id",
    "title_clusters": f"""
        WITH RECURSIVE {ARTICLES}, {_CLASSES}, n AS (SELECT row_number() OVER (ORDER BY id) AS k, id FROM c0), {_ADJ}, {_WALK}
        SELECT c0.id AS article_id, CASE WHEN c0.id IN (SELECT id FROM p) THEN c0.id ELSE (SELECT min(a) FROM e WHERE e.b = c0.id AND e.a IN (SELECT id FROM p)) END AS representative FROM c0""",
    "distinct_picks": f"""
        WITH RECURSIVE {ARTICLES}, {_CLASSES}, n AS (SELECT row_number() OVER (ORDER BY id) AS k, id FROM c0 WHERE id % 4 <> 1), {_ADJ}, {_WALK} SELECT id AS article_id FROM p ORDER BY id LIMIT 50""",
    "new_against_history": f"""
        WITH RECURSIVE {ARTICLES}, {_CLASSES}, {_BOTH}, n AS (SELECT row_number() OVER (ORDER BY id) AS k, id FROM c0 WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM z WHERE z.a = c0.id AND z.b % 2 = 0)),
        {_ADJ}, {_WALK} SELECT id AS article_id FROM p""",
    "restored_orphans": f"""
        WITH RECURSIVE {ARTICLES}, {_CLASSES}, {_BOTH}, n AS (SELECT row_number() OVER (ORDER BY id) AS k, id FROM c0 WHERE id % 3 > 0
            AND EXISTS (SELECT 1 FROM z WHERE z.a = c0.id AND z.b % 3 > 0) AND NOT EXISTS (SELECT 1 FROM z WHERE z.a = c0.id AND z.b % 3 = 0)),
        {_ADJ}, {_WALK} SELECT id AS article_id FROM p""",
    "group_removals": f"""
        WITH {ARTICLES}, k AS (SELECT article_id, row_number() OVER (PARTITION BY md5(title) ORDER BY article_id % 10 = 0 DESC, len(regexp_extract_all(src_body, '\\S+')) DESC, length(src_body) DESC, article_id) AS k FROM a)
        SELECT article_id FROM k WHERE k > 1 AND article_id % 10 <> 0""",
    "related_passages": f"""
        WITH h0 AS (SELECT doc_id AS other, coalesce(text, '') AS src_body FROM documents), h1 AS (SELECT other, {_STEMS} AS x FROM h0), h AS (SELECT other, list_distinct(x) AS toks FROM h1),
        i0 AS (SELECT item_id AS id, coalesce(text, '') AS src_body FROM benchmark), i AS (SELECT id, list_distinct({_STEMS}) AS toks FROM i0),
        m AS (SELECT p.id, q.other, count(*) AS c FROM (SELECT id, unnest(toks) AS t FROM i) p JOIN (SELECT other, unnest(toks) AS t FROM h) q USING (t) GROUP BY ALL),
        o AS (SELECT m.id, m.other, c / (len(i.toks) + len(h.toks) - c) AS overlap FROM m JOIN i USING (id) JOIN h USING (other)),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) AS k FROM o) SELECT id, other, round(overlap, 6) AS overlap FROM k WHERE k <= 6""",
    "body_origins": f"""
        WITH {ARTICLES}, n AS (SELECT *, title || ' ' || src_body AS feed, CASE WHEN article_id % 3 > 0 THEN len(regexp_extract_all(src_body, '\\S+')) ELSE 0 END AS p FROM a), m AS (SELECT *, len(regexp_extract_all(feed, '\\S+')) AS f FROM n)
        SELECT article_id, CASE WHEN p > 100 THEN 'page' WHEN f >= 100 THEN 'feed' ELSE 'none' END AS origin, md5(CASE WHEN p > 100 THEN src_body WHEN f >= 100 THEN feed ELSE '' END) AS text FROM m""",
    "repair_actions": f"""
        WITH {ARTICLES}, b AS (SELECT *, src_body || CASE WHEN article_id % 2 = 0 THEN ' and' ELSE '' END AS body FROM a), c AS (SELECT *, regexp_extract(body, '(?s)^.*[.!?…]["''”’»)]*') AS cut, regexp_replace(body, '\\s+$', '') AS bare,
            len(regexp_extract_all(title, '\\S+')) AS ns, len(regexp_extract_all(body, '\\S+')) AS nb, len(regexp_extract_all(src_body, '\\S+')) AS na FROM b)
        SELECT article_id, CASE WHEN bare = '' OR regexp_matches(bare, '[.!?…"''”’»)]$') THEN 'keep' WHEN ns > 80 THEN 'regenerate'
            WHEN len(regexp_extract_all(CASE WHEN cut <> '' THEN cut ELSE body END, '\\S+')) >= 15 THEN 'cut' WHEN article_id % 9 <> 0 AND nb < 25 THEN 'drop' ELSE 'keep' END AS action,
            nb < 110 AND na >= 60 AS needs_longer FROM c""",
    "source_windows": """
        WITH e AS (SELECT event_id, CAST(user_id % 40 AS VARCHAR) AS source, date_diff('second', ts, TIMESTAMP '2024-01-25 00:00:00') / 3600 AS age FROM events),
        f AS (SELECT *, CASE WHEN source IN ('3', '7') OR max(CASE WHEN age IS NULL OR age <= 96 THEN 1 ELSE 0 END) OVER (PARTITION BY source) = 0 THEN 168 ELSE 96 END AS hours FROM e)
        SELECT event_id, hours FROM f WHERE age IS NULL OR age <= hours""",
    "daily_briefs": f"""
        WITH {ARTICLES}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq) AS k FROM a) SELECT day, 'Today: ' || string_agg(title, '; ' ORDER BY seq) AS brief FROM k WHERE k <= 8 GROUP BY day""",
    "canonical_urls": f"""
        WITH p AS (SELECT page_id, url, replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') AS domain,
            regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS q FROM pages),
        k AS (SELECT *, list_sort(list_filter(q, lambda x: contains(x, '=') AND length(split_part(x, '=', 2)) > 0 AND NOT list_contains([{_q(lx.TRACKING)}], lower(split_part(x, '=', 1))))) AS kept FROM p)
        SELECT page_id, regexp_replace('https://' || domain || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '/+$', '') AS url_norm, domain,
            CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE '#' END AS link FROM k""",
    "page_texts": f"WITH {_BLOCKS}, {_MAIN} SELECT page_id, 'article' AS strategy, n_words, text FROM m WHERE n_words > 100",
    "page_yield": f"WITH {_BLOCKS}, {_MAIN} SELECT 'article' AS strategy, count(*) AS n, avg(n_words) AS avg_words, max(n_words) AS max_words FROM m WHERE n_words > 100",
    "extractor_yield": f"""
        WITH {_BLOCKS}, {_MAIN}, v AS (
            SELECT source, starts_with(source, 'blog.') AS own, 'article' AS strategy, n_words, n_words > 100 AS chosen FROM m
            UNION ALL SELECT source, false, 'article', n_words, false FROM m WHERE starts_with(source, 'blog.')
            UNION ALL SELECT source, true, 'div.ad', 0, false FROM m WHERE starts_with(source, 'm.')),
        g AS (SELECT source, own, strategy, count(*) AS n_pages, count_if(n_words > 100) AS n_enough, count_if(chosen) AS n_chosen, round(avg(n_words), 6) AS avg_words, max(n_words) AS max_words FROM v GROUP BY ALL)
        SELECT *, own AND 2 * n_enough >= n_pages AS proposed FROM g""",
    "edited_pages": f"""
        WITH {_BLOCKS}, k AS (SELECT page_id, t, min(i) AS i FROM b WHERE len(t) > 20 AND NOT regexp_matches(t, '{pg.EDIT_NOT_TEXT}') GROUP BY ALL),
        e AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM k GROUP BY page_id)
        SELECT p.page_id, CASE WHEN text IS NULL THEN 'none' ELSE 'article' END AS strategy, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS n_words, md5(coalesce(text, '')) AS text
        FROM pages p LEFT JOIN e USING (page_id)""",
    "page_links": """
        SELECT page_id, 'https://' || replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'www.', '') || '/story/1000' || page_id AS url, 'All about story ' || page_id AS title FROM pages""",
    "content_hashes": f"WITH {ARTICLES} SELECT article_id, md5(regexp_replace(lower(title || coalesce(lang, '')), '^\\s+|\\s+$', '', 'g')) AS content_hash FROM a",
    "word_counts": f"WITH {ARTICLES} SELECT article_id, len(regexp_extract_all(src_body, '\\S+')) AS n_words, array_to_string(regexp_extract_all(src_body, '\\S+')[1:60], ' ') AS lead FROM a",
    "full_sentences": f"""
        WITH {ARTICLES}, c AS (SELECT article_id, src_body, regexp_extract(src_body, '(?s)^.*[.!?…]["''”’»)]*') AS cut, regexp_replace(src_body, '\\s+$', '') AS bare FROM a)
        SELECT article_id, md5(CASE WHEN cut <> '' THEN cut ELSE src_body END) AS cut, bare <> '' AND NOT regexp_matches(bare, '[.!?…"''”’»)]$') AS is_truncated FROM c""",
    "keyword_stems": f"""
        WITH {ARTICLES}, k AS (SELECT article_id, {_STEMS} AS x FROM a), f AS (SELECT article_id, {_FIRST} AS y FROM k)
        SELECT article_id, array_to_string(list_sort(y), ',') AS stems, array_to_string(list_sort(y[1:40]), ',') AS lead FROM f""",
    "code_names": f"WITH {ARTICLES} SELECT article_id, array_to_string(list_sort({_CODES}), ',') AS codes FROM a",
    "fact_tokens": f"WITH {ARTICLES} SELECT article_id, array_to_string(list_sort(list_transform(regexp_extract_all(src_body, '(?i)CVE-[0-9]{{4}}-[0-9]+|[0-9]+(?:[.,][0-9]+)*'), lambda x: lower(x))), ',') AS facts FROM a",
    "foreign_texts": f"""
        WITH {ARTICLES}, h AS (SELECT article_id, regexp_extract_all(src_body, '\\S+')[1:40] AS h FROM a)
        SELECT article_id, NOT regexp_matches(array_to_string(h, ' '), '[{TURKISH}]') AND len(list_filter(h, lambda w: regexp_matches(w, '^[A-Za-z]+$'))) >= greatest(8.0, 0.6 * len(h)) AS is_foreign FROM h""",
    "title_stems": f"WITH {ARTICLES} SELECT article_id, array_to_string(list_sort({_TITLE}), ',') AS stems FROM a",
    "unseen_articles": f"""
        WITH {ARTICLES}, h AS (SELECT article_id, day, md5(regexp_replace(lower(title || coalesce(lang, '')), '^\\s+|\\s+$', '', 'g')) AS content_hash FROM a)
        SELECT article_id, content_hash FROM h WHERE day = DATE '2024-01-30' AND content_hash NOT IN (SELECT content_hash FROM h WHERE day >= DATE '2024-01-23' AND day < DATE '2024-01-30')""",
    "similar_title_stems": f"WITH {ARTICLES}, {_CLASSES} SELECT a, b, round(overlap, 6) AS overlap FROM ce",
    "first_wins_titles": f"WITH RECURSIVE {ARTICLES}, {_CLASSES}, n AS (SELECT row_number() OVER (ORDER BY id) AS k, id FROM c0), {_ADJ}, {_WALK} SELECT id AS article_id FROM p",
    "same_code_names": f"""
        WITH {ARTICLES}, n AS (SELECT article_id, day, unnest({_CODES}) AS code FROM a), f AS (SELECT day, code, min(article_id) AS first FROM n GROUP BY ALL)
        SELECT article_id, min(first) AS first FROM n JOIN f USING (day, code) WHERE article_id <> first GROUP BY article_id""",
    "generic_stems": f"""
        WITH {ARTICLES}, k AS (SELECT article_id, unnest(list_distinct({_STEMS})) AS stem FROM a)
        SELECT stem, count(*) AS df FROM k GROUP BY stem HAVING count(*) > {lx.GENERIC_SHARE} * (SELECT count(*) FROM documents)""",
    "actors": f"""
        WITH {ARTICLES} SELECT article_id, array_to_string(list_sort(list_filter(['tion', 'ouer', 'schen'], lambda n: contains(lower(src_body), n))), ',') AS actors FROM a""",
}
