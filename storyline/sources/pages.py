"""HTML pages to blocks, main texts and links. Parsing needs a parser, so it runs in tasks over Arrow batches; all choices are made natively."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, host
from ..operators.base import checkpointed

#: Tags whose text is a block, class hints of containers, what a block must not hold, and the fewest characters and words.
BLOCK_TAGS = ("p", "h1", "h2", "h3", "li")
CLASS_HINT = r"(?i)content|article|post|body"
NOT_TEXT = r"(?i)cookie|subscribe|newsletter"
LEAST_CHARS, LEAST_WORDS = 20, 100

#: The same where an editor adds a page by hand.
EDIT_TAGS = ("p", "h1", "h2", "h3", "h4", "li", "blockquote")
EDIT_JUNK = ("noscript", "nav", "header", "footer", "aside", "form")
EDIT_HINT = r"(?i)content|article|article-body|story|entry|post|haber|icerik|metin|detay|main-text|news-body|body-text|text-body"
EDIT_NOT_TEXT = r"(?i)cookie|subscribe|newsletter|abone ol|çerez|gizlilik politika|tüm hakları|all rights reserved|advertisement|reklam"
EDIT_METAS = ("description", "og:description", "twitter:description")
EDIT_WORDS = 50

#: Elements without an end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

PARTS = ("tag", "text", "within", "outer", "junk", "href")
KINDS = "page_id long, url string, tag array<string>, text array<string>, within array<array<int>>, outer array<int>, junk array<boolean>, href array<string>"

#: Pages whose parts are held at once.
PAGES = 256

#: Up to so many sources' selectors are broadcast; beyond that they are joined.
BROADCAST_SOURCES = 100_000


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json
    import re
    from collections import Counter
    from html.parser import HTMLParser

    class Page(HTMLParser):
        """Elements are kept on a stack; a text belongs to the innermost block that is open, so that the work is linear in the page."""

        def __init__(self, selectors: list[dict]) -> None:
            super().__init__(convert_charrefs=True)
            self.wanted = {k: ("selector", x["strategy"], self.selected(x)) for k, x in enumerate(selectors)}
            hinted = lambda tag, given: tag == "div" and re.search(CLASS_HINT, given.get("class") or "")
            for k, (name, fit) in enumerate((("article", lambda tag, given: tag == "article"), ("main", lambda tag, given: tag == "main"), ("div", hinted)), len(selectors)):
                self.wanted[k] = ("default", name, fit)
            self.stack, self.depth, self.inside, self.outer, self.n_outer = [], Counter(), {}, None, 0
            self.block, self.text, self.href, self.anchor, self.out = None, [], None, [], []

        @staticmethod
        def selected(x: dict):
            def fit(tag: str, given: dict) -> bool:
                held = given.get("class") or ""
                return all((not x.get("name") or tag == x["name"], not x.get("id") or given.get("id") == x["id"], not x.get("class") or x["class"] in [held, *held.split()]))

            return fit

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in VOID_TAGS:
                self.handle_endtag(tag)

        def handle_starttag(self, tag, attrs):
            given = dict(attrs)
            if tag == "a":
                self.href, self.anchor = given.get("href"), []
            if tag == "meta" and (given.get("name") or given.get("property")) in EDIT_METAS and given.get("content"):
                self.out.append(("meta", " ".join(given["content"].split()), [EDIT_METAS.index(given.get("name") or given.get("property"))], None, False, None))
            if tag in VOID_TAGS:
                return
            if tag in EDIT_TAGS:
                self.flush()
                if self.stack and self.stack[-1][0] == tag and tag in ("p", "li"):
                    self.pop()  # a paragraph ends where the next one starts
            found = [k for k, (_, _, fit) in self.wanted.items() if fit(tag, given)]
            for k in found:
                kind, name, _ = self.wanted.pop(k)
                self.out.append((kind, name, [k], None, False, None))
                self.inside[k] = len(self.stack)
            if self.outer is None and tag in ("div", "section") and (re.search(EDIT_HINT, given.get("class") or "") or re.search(EDIT_HINT, given.get("id") or "")):
                self.outer, self.n_outer = len(self.stack), self.n_outer + 1
            # A container isn't a block of its own.
            self.stack.append((tag, found))
            self.depth[tag] += 1
            if tag in EDIT_TAGS:
                within = [k for k in self.inside if k not in found]
                outer = self.n_outer if self.outer is not None else None
                self.block = (len(self.stack), tag, within, outer, any(self.depth[t] for t in EDIT_JUNK))

        def handle_endtag(self, tag):
            if tag == "a" and self.href:
                self.out.append(("a", " ".join("".join(self.anchor).split()), [], None, False, self.href))
                self.href = None
            while self.depth[tag] and self.pop() != tag:
                pass

        def pop(self) -> str:
            if self.block and self.block[0] == len(self.stack):
                self.flush()
            tag, found = self.stack.pop()
            self.depth[tag] -= 1
            for k in found:
                del self.inside[k]
            if self.outer == len(self.stack):
                self.outer = None
            return tag

        def handle_data(self, data):
            if self.href:
                self.anchor.append(data)
            if self.block and not self.depth["script"] and not self.depth["style"]:
                self.text.append(data)

        def flush(self):
            text = " ".join("".join(self.text).split())
            if self.block and text:
                self.out.append((self.block[1], text, *self.block[2:], None))
            self.text, self.block = [], None

    for batch in batches:
        for start in range(0, len(batch), PAGES):
            rows, some = [], batch.iloc[start : start + PAGES]
            for page, url, html, selectors in zip(some["page_id"], some["url"], some["html"], some["selectors"], strict=True):
                parser = Page(json.loads(selectors or "[]"))
                parser.feed(html or "")
                parser.close()
                parser.flush()
                rows.append((page, url, *([list(x) for x in zip(*parser.out, strict=True)] or [[]] * len(PARTS))))
            yield pd.DataFrame(rows, columns=["page_id", "url", *PARTS])


def page_parts(pages: DataFrame, selectors: DataFrame | None = None, source: Column | None = None) -> DataFrame:
    """(page_id, url, parts) of pages (page_id, url, html); parts: (tag, text, within, outer, junk, href) of blocks, anchors, descriptions and containers, in order.

    selectors: (source, rank, name, class, id), the first element that has all that is given being meant; a page's are those of its ``source``, by default
    its host. Containers have the tag selector or default, their name as text and their number in ``within``; a block's ``within`` has the numbers of the containers
    around it, ``outer`` that of the outermost one that an editor would take. Pages without HTML have no parts. A page is read once, and all that follows is a map over it.
    """
    own = pages.select("page_id", "url", "html", (host(F.col("url")) if source is None else source).alias("_source"))
    if selectors is None:
        held = own.withColumn("selectors", F.lit(None).cast("string"))
    else:
        label = F.concat(F.coalesce("name", F.lit("")), F.coalesce(F.concat(F.lit("."), "class"), F.lit("")), F.coalesce(F.concat(F.lit("#"), "id"), F.lit("")))
        each = F.array_sort(F.collect_list(F.struct("rank", label.alias("strategy"), "name", "class", "id")))
        known = checkpointed(selectors.groupBy(F.col("source").alias("_source")).agg(F.to_json(each).alias("selectors")))
        held = own.join(F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known, "_source", "left")
    return held.select("page_id", "url", "html", "selectors").mapInPandas(_blocks, KINDS).select("page_id", "url", F.arrays_zip(*PARTS).alias("parts"))


def _let(x: Column, f) -> Column:
    """f(x), x being worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: x["text"]), "\n")


def _n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def _is_container(x: Column) -> Column:
    return x["tag"].isin("selector", "default")


def _containers(parts: Column) -> Column:
    """The containers that a page has, (k, own, strategy, n_words, text), in the order in which they are tried."""
    blocks = F.filter(parts, lambda x: x["tag"].isin(*BLOCK_TAGS) & (F.length(x["text"]) > LEAST_CHARS) & ~x["text"].rlike(NOT_TEXT))

    def of(b: Column) -> Column:
        def told(c: Column) -> Column:
            k = F.get(c["within"], F.lit(0))
            text = _joined(F.filter(b, lambda x: F.array_contains(x["within"], k)))
            return _let(text, lambda t: F.struct(k.alias("k"), (c["tag"] == "selector").alias("own"), c["text"].alias("strategy"), _n_words(t).alias("n_words"), t.alias("text")))

        return F.array_sort(F.transform(F.filter(parts, _is_container), told))

    return _let(blocks, of)


def _chosen(held: Column) -> Column:
    """The container that gives the main text, or null: the first selector's that there is, if it has text, else the first other one's that has."""
    own, rest = F.get(F.filter(held, lambda x: x["own"]), F.lit(0)), F.get(F.filter(held, lambda x: ~x["own"] & (x["n_words"] > 0)), F.lit(0))
    best = F.when(own["n_words"] > 0, own).otherwise(rest)
    return F.when(best["n_words"] > LEAST_WORDS, best)


def container_texts(parts: DataFrame) -> DataFrame:
    """(page_id, url, k, own, strategy, n_words, text, chosen) of each container that a page has; ``own``: by a selector of its source; ``chosen``: it gives the main text."""
    both = parts.select("page_id", "url", _let(_containers(F.col("parts")), lambda h: F.struct(h.alias("held"), _chosen(h)["k"].alias("best"))).alias("x"))
    return both.select("page_id", "url", "x.best", F.explode("x.held").alias("x")).select("page_id", "url", "x.*", F.coalesce(F.col("x.k") == F.col("best"), F.lit(False)).alias("chosen"))


def main_text(parts: DataFrame) -> DataFrame:
    """(page_id, strategy, n_words, text): the text of the first of the source's selectors that the page has or, if that has none, of the first of ``article``, ``main`` and
    a ``div`` with a hint that has; pages with LEAST_WORDS words or fewer are left out."""
    best = parts.select("page_id", _let(_containers(F.col("parts")), _chosen).alias("x")).where("x IS NOT NULL")
    return best.select("page_id", "x.strategy", "x.n_words", "x.text")


def extractor_yield(parts: DataFrame, source: Column | None = None) -> DataFrame:
    """(source, own, strategy, n_pages, n_enough, n_chosen, avg_words, max_words, proposed): what each strategy finds on a source's pages.

    n_enough: pages where it has over LEAST_WORDS words; n_chosen: where it gives the main text. Proposed is a source's first selector that is enough on half
    of the pages that have it.
    """
    texts = container_texts(parts).withColumn("source", host(F.col("url")) if source is None else source)
    each = texts.groupBy("source", "own", "strategy").agg(
        F.min("k").alias("k"), F.count("*").alias("n_pages"), F.count_if(F.col("n_words") > LEAST_WORDS).alias("n_enough"), F.count_if("chosen").alias("n_chosen"),
        F.avg("n_words").alias("avg_words"), F.max("n_words").alias("max_words"),
    )
    fit = F.col("own") & (2 * F.col("n_enough") >= F.col("n_pages"))
    first = F.min(F.when(fit, F.col("k"))).over(Window.partitionBy("source"))
    return each.withColumn("proposed", F.coalesce(fit & (F.col("k") == first), F.lit(False))).drop("k")


def edited_text(parts: DataFrame) -> DataFrame:
    """(page_id, strategy, n_words, text) of pages that an editor adds by hand: every block once, none from navigation, headers, asides and forms.

    ``article`` and then ``main``, if there is one, until one has EDIT_WORDS words; else the longest container with a hint, an outer one having all that those inside have;
    else the whole page if that is longer; descriptions are added to what is short even so. A page without text has an empty one, its strategy being ``none``.
    """
    fit = lambda x: x["tag"].isin(*EDIT_TAGS) & ~x["junk"] & (F.length(x["text"]) > LEAST_CHARS) & ~x["text"].rlike(EDIT_NOT_TEXT)
    first = lambda f: F.get(F.filter("parts", f), F.lit(0))
    number = lambda name: F.get(first(lambda x: (x["tag"] == "default") & (x["text"] == name))["within"], F.lit(0))
    meta = lambda k: first(lambda x: (x["tag"] == "meta") & (F.get(x["within"], F.lit(0)) == k))["text"]
    metas = F.array_join(F.array(*[meta(k) for k in range(len(EDIT_METAS))]), "\n")  # nulls are left out

    def once(name: str, blocks: Column) -> Column:
        text = F.array_join(F.array_distinct(F.transform(blocks, lambda x: x["text"])), "\n")
        return _let(text, lambda t: F.struct(_n_words(t).alias("n_words"), F.when(t != "", name).otherwise("none").alias("strategy"), t.alias("text")))

    def longest(b: Column) -> Column:
        """Of the runs of blocks in one outermost container, the one with most words, the first of such."""
        outer = lambda i: F.get(b, i)["outer"]
        starts = F.when(F.size(b) > 0, F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | ~outer(i).eqNullSafe(outer(i - 1)))).otherwise(F.array().cast("array<int>"))
        runs = _let(starts, lambda s: F.transform(s, lambda i, j: F.slice(b, i + 1, F.coalesce(F.get(s, j + 1), F.size(b)) - i)))
        held = F.transform(F.filter(runs, lambda r: F.get(r, F.lit(0))["outer"].isNotNull()), lambda r, j: _let(once("container", r), lambda x: F.struct(x["n_words"].alias("n"), (-j).alias("j"), x.alias("x"))))
        return F.coalesce(F.array_max(held)["x"], once("container", F.slice(b, 1, 0)))

    def better(old: Column, new: Column) -> Column:
        return F.when((old["n_words"] < EDIT_WORDS) & (new["n_words"] > old["n_words"]), new).otherwise(old)

    def text_of(b: Column) -> Column:
        inside = lambda name: once(name, F.filter(b, lambda x: F.array_contains(x["within"], number(name))))
        start = _let(inside("article"), lambda a: F.when((a["n_words"] >= EDIT_WORDS) | number("main").isNull(), a).otherwise(inside("main")))
        return _let(_let(start, lambda x: better(x, longest(b))), lambda x: better(x, once("page", b)))

    best = parts.select("page_id", metas.alias("metas"), _let(F.filter("parts", fit), text_of).alias("x"))
    text = F.when((F.col("x.n_words") < EDIT_WORDS) & (F.col("metas") != ""), F.trim(F.concat("x.text", F.lit("\n"), "metas"), F.lit("\n "))).otherwise(F.col("x.text"))
    return best.select("page_id", "x.strategy", text.alias("text")).select("page_id", "strategy", _n_words(F.col("text")).alias("n_words"), "text")


def expanded_links(parts: DataFrame, skip: str = r"(?i)newsletter|digest|bulletin") -> DataFrame:
    """(page_id, url, title): links of a page to articles of its own host, by a number of four digits and more in the path; each URL once."""
    links = parts.select("page_id", "url", F.posexplode(F.filter("parts", lambda x: x["tag"] == "a")).alias("pos", "x")).select("page_id", "url", "pos", "x.text", "x.href")
    own = links.withColumn("to", F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit("https://"), host(F.col("url")), F.col("href"))))
    fit = (host(F.col("to")) == host(F.col("url"))) & F.col("to").rlike(r"/\d{4,}") & ~F.col("to").rlike(skip) & (F.length("text") >= 15)
    first = own.where(fit).withColumn("link", canonical_url(F.col("to"))).withColumn("k", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("pos")))
    return first.where("k = 1").select("page_id", F.col("link").alias("url"), F.col("text").alias("title"))
