"""Predicates and small policies on articles and generated texts, as column expressions. Term lists are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import word_count, words


def any_of(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms, whatever the case."""
    quoted = "|".join("\\Q" + t.lower() + "\\E" for t in terms)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(quoted) if terms else F.lit(False)


def attributed(text: Column, terms: list[str], countries: list[str], links: list[str], actors: list[str], near: int = 60) -> Column:
    """Whether a text blames a state: by a term, or by a country near a link word or an actor word, either way round."""
    t, group = F.coalesce(text, F.lit("")), lambda xs: "(?:" + "|".join(f"\\Q{x}\\E" for x in xs) + ")"
    out = any_of(t, terms)
    for other in (links, actors):
        if countries and other:
            out = out | t.rlike(f"(?iUs){group(countries)}.{{0,{near}}}{group(other)}|{group(other)}.{{0,{near}}}{group(countries)}")
    return out


def actor_evidence(text: Column, actors: Column, **terms: list[str]) -> Column:
    return attributed(text, **terms) | F.exists(actors, lambda a: ~a.startswith("cve") & ~a.startswith("ghsa"))


def vulnerability(category: Column, promoted: Column, title: Column, terms: list[str], categories: list[str]) -> Column:
    """Whether an item goes to the vulnerabilities: by category unless promoted, else by an id or a term in its title."""
    named = F.coalesce(title, F.lit("")).rlike(r"(?i)\bCVE-\d{4}-\d{4,7}\b") | any_of(title, terms)
    return ~F.coalesce(promoted, F.lit(False)) & F.when(category.isNotNull(), category.isin(categories)).otherwise(named)


def body_origin(page: Column, feed: Column, least: int = 100) -> Column:
    """Struct(text, origin): the page's text if it has over ``least`` words, else the feed's if it has as many, else none."""
    page_ok, feed_ok = word_count(page) > least, word_count(feed) >= least
    return F.struct(F.when(page_ok, page).when(feed_ok, feed).alias("text"), F.when(page_ok, "page").when(feed_ok, "feed").otherwise("none").alias("origin"))


def reroute(source: Column, body: Column) -> Column:
    """An annotator's removal becomes a rewrite if the source is long enough and the body is short or in plain English."""
    english = F.size(F.filter(F.slice(words(body), 1, 30), lambda w: w.rlike("^[A-Za-z]+$"))) > 15
    return F.when((word_count(source) > 80) & ((word_count(body) < 50) | english), "regenerate").otherwise("remove")


def repair(is_truncated: Column, cut: Column, source: Column, body: Column, headline: Column) -> Column:
    """What happens to a truncated body: rewritten from a long source, cut to full sentences if enough stays, dropped if short and no headline."""
    return F.when(~is_truncated, "keep").when(word_count(source) > 80, "regenerate").when(word_count(cut) >= 15, "cut").when(~headline & (word_count(body) < 25), "drop").otherwise("keep")


def accepts_rewrite(old: Column, new: Column, casual: Column) -> Column:
    # 55 % in whole numbers: as a double, 0.55 * 20 and the like are above their value.
    return (20 * word_count(new) >= F.greatest(F.lit(300), 11 * word_count(old))) & (F.size(casual) == 0)


def needs_longer(body: Column, source: Column) -> Column:
    return (word_count(body) < 110) & (word_count(source) >= 60)


def longer(old: Column, new: Column) -> Column:
    return F.when(word_count(new) > word_count(old), new).otherwise(old)


def engagement(platform: Column, a: Column, b: Column, c: Column) -> Column:
    """Scores of social signals: favourites + 2 reblogs + replies; points + 3 comments; severity * 10 + cvss."""
    return F.when(platform == "mastodon", a + 2 * b + c).when(platform == "hackernews", a + 3 * b).when(platform == "advisory", a * 10 + b).otherwise(a)


def social_text(html: Column, most: int = 200) -> Column:
    """Text of a post: no tags, URLs or hashtags, single blanks, ``most`` characters."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"https?://\S+", " "), r"#\S+", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, most)


def without_markup(page: Column) -> Column:
    """A page without fences and bold marks that leaked into its text; style blocks stay as they are."""
    parts = F.split(page, r"(?<=</style>)|(?=<style)", -1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<style"), p).otherwise(F.regexp_replace(p, r"```\w*|\*\*", ""))), "")


def effective_hours(items: DataFrame, now: Column, slow: list[str], base: int = 96, wide: int = 168) -> DataFrame:
    """Items in their source's window. Sources that are slow, or whose items are all older than the base window, have the wide one. No time passes."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("pub_ts")) / 3600
    fresh = F.max(F.when(F.col("pub_ts").isNull() | (age <= base), 1).otherwise(0)).over(Window.partitionBy("source"))
    hours = F.when(F.col("source").isin(slow) | (fresh == 0), wide).otherwise(base)
    return items.withColumn("hours", hours).where(F.col("pub_ts").isNull() | (age <= F.col("hours")))


def brief(rows: DataFrame, by: list[str], lead: str, most: int = 8) -> DataFrame:
    """A deterministic summary: the lead and the first titles in order. rows: (…, pos, title)."""
    titles = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "title"))), 1, most), lambda x: x["title"])
    near = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("_k") <= most)
    return near.groupBy(*by).agg(F.concat(F.lit(lead), F.array_join(titles, "; ")).alias("brief"))


def early(text: Column, terms: list[str], most: int = 60) -> Column:
    """Whether a term stands in a text's first ``most`` words."""
    return any_of(F.array_join(F.slice(words(text), 1, most), " "), terms)


def newsletter(url: Column, patterns: list[str]) -> Column:
    """Whether a URL is that of a newsletter or digest."""
    return any_of(url, patterns)


def social_filter(signals: DataFrame, least: dict[str, float], chars: int, skip: list[str]) -> DataFrame:
    """Signals (platform, title, score, …) of their platform's least score, if it has one, with ``chars`` characters and none of the skipped terms."""
    limit = F.coalesce(*[F.when(F.col("platform") == p, F.lit(x)) for p, x in least.items()], F.lit(0.0))
    return signals.where((F.col("score") >= limit) & (F.length("title") >= chars) & ~any_of(F.col("title"), skip))


def published(items: Column, least: Column, is_fallback: Column) -> Column:
    """Status of a report: a fallback isn't published, one below the least number of items is thin."""
    return F.when(is_fallback, "fallback").when(items < least, "thin").otherwise("ok")
