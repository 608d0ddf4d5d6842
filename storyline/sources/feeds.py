"""Readers of feed payloads, digests, ledgers, error logs and annotators' answers: text columns in, rows out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_value
from ..operators.base import checkpointed


def feed_items(payloads: DataFrame, most: int = 40) -> DataFrame:
    """(source, pos, title, link, description, date) of RSS and Atom payloads (source, payload); the first ``most`` of each feed, none without title.

    Each item is cut out and parsed by itself, so a broken one, or a feed that ends early, doesn't cost the others.
    """
    body = F.regexp_replace("payload", r"(?s)<\?xml.*?\?>", "")
    cut = payloads.select("source", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))).alias("pos", "x"))

    def inner(tag: str) -> Column:
        raw = F.regexp_extract("x", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        bare = F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(a), F.lit(b))
        return F.nullif(F.trim(bare), F.lit(""))

    href = F.nullif(F.regexp_extract("x", r"<link[^>]*\shref=[\"']([^\"']+)", 1), F.lit(""))
    named = cut.select(
        "source", "pos", inner("title").alias("title"), F.coalesce(inner("link"), href).alias("link"),
        F.coalesce(inner("content:encoded"), inner("content"), inner("description"), inner("summary")).alias("description"), F.coalesce(inner("pubDate"), inner("published")).alias("date"),
    )
    w = Window.partitionBy("source").orderBy("pos")
    return named.where("title IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def digest_articles(files: DataFrame) -> DataFrame:
    """(id, source, title, date, link, body) of digest texts (value): blocks between rules of = signs, headed ``[n] source - title``."""
    each = files.select(F.explode(F.split("value", r"[=═]{40,}")).alias("x")).where(F.col("x").rlike(r"(?m)^\[\d+\] "))
    head = r"(?m)^\[(\d+)\] (.*?) - (.*)$"
    body = F.regexp_replace(F.regexp_replace("x", r"(?m)^(?:\[\d+\] .*|Tarih:.*|Link:.*)$", ""), r"(?s)^\s+|\s+$", "")
    return each.select(
        F.regexp_extract("x", head, 1).cast("long").alias("id"), F.regexp_extract("x", head, 2).alias("source"), F.trim(F.regexp_extract("x", head, 3)).alias("title"),
        F.trim(F.regexp_extract("x", r"(?m)^Tarih:(.*)$", 1)).alias("date"), F.trim(F.regexp_extract("x", r"(?m)^Link:(.*)$", 1)).alias("link"), body.alias("body"),
    )


def seen_links(lines: DataFrame, cutoff: Column) -> DataFrame:
    """(day, link, title, content_hash) of ledger lines (line_no, value) from ``cutoff`` on; titles may hold tabs, bad lines are skipped.

    The last column is the hash if it has 32 hex digits; older lines have none.
    """
    parts = lines.select("line_no", F.split("value", "\t", -1).alias("p")).where(F.size("p") >= 3)
    hashed = F.element_at("p", -1).rlike("^[0-9a-f]{32}$") & (F.size("p") > 3)
    title = F.array_join(F.slice("p", F.lit(3), F.size("p") - 2 - F.when(hashed, 1).otherwise(0)), "\t")
    out = parts.select("line_no", F.try_to_date(F.get("p", F.lit(0)), "yyyy-MM-dd").alias("day"), F.get("p", F.lit(1)).alias("link"), title.alias("title"), F.when(hashed, F.element_at("p", -1)).alias("content_hash"))
    return out.where(F.col("day") >= cutoff)


def failed_sources(lines: DataFrame, since: Column, kinds: list[str]) -> DataFrame:
    """(source) of error-log lines (value) ``yyyy-MM-dd HH:mm | KIND - source: detail`` of the kinds, from ``since`` on."""
    form = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}) \| (.*?) - (.*?):"
    out = lines.select(F.try_to_timestamp(F.regexp_extract("value", form, 1), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), F.regexp_extract("value", form, 2).alias("kind"), F.regexp_extract("value", form, 3).alias("source"))
    return out.where((F.col("ts") >= since) & F.col("kind").isin(kinds)).select("source").distinct()


#: How annotators name an article's id, and fields that make an object an article's content.
ID_FIELDS, CONTENT_FIELDS = ("id", "ID", "Id"), ("tr_title", "paragraph")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _entries(v: Column) -> Column:
    """Keys and values of an object, or items of a list with null keys, in order; none of anything else."""
    pair = "array<struct<k:string,x:variant>>"
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(
        F.when(_is(v, "OBJECT"), F.transform(fields, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("x"))).cast(pair)),
        F.when(_is(v, "ARRAY"), F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("k"), x.alias("x"))).cast(pair)),
        F.array().cast(pair),
    )


def answers(raw: DataFrame, asked: DataFrame | None = None, ids: tuple[str, ...] = ID_FIELDS, content: tuple[str, ...] = CONTENT_FIELDS) -> DataFrame:
    """(batch, article_id, value) of annotators' answers (batch, text), whatever their outer shape; value is JSON. A batch has one answer.

    A map from id to content, bare, in wrappers of one key, or as items of a list; a list of contents that name their ids; or, if ``asked`` (batch, article_id, seq) has just as
    many articles of the batch, a list of contents without ids, which then are those of the articles in order. A map is one from ids to contents if half its
    values have a field of ``content``; a map of one other key is a wrapper, however deep. Of an id's values the last one counts. Ids that are
    no whole numbers are left out, as is what doesn't parse.
    """
    field = lambda x, names: reduce(or_, [F.try_variant_get(x, f"$.{n}", "variant").isNotNull() for n in names])
    holds = lambda x: _is(x, "OBJECT") & field(x, content)
    mapped = lambda v, e: _is(v, "OBJECT") & (F.size(e) > 0) & (F.size(F.filter(e, lambda p: holds(p["x"]))) >= F.greatest(F.lit(1), F.floor(F.size(e) / 2)))
    level = raw.select("batch", json_value(F.col("text")).alias("v"), F.array().cast("array<int>").alias("at"), F.lit(True).alias("top")).where("v IS NOT NULL")
    found = bare = None
    while True:
        held = checkpointed(level.select("*", _entries(F.col("v")).alias("e")))
        if held.isEmpty():
            break
        listed, one = _is(F.col("v"), "ARRAY"), (F.size("e") == 1) & (_is(F.element_at("e", 1)["x"], "OBJECT") | _is(F.element_at("e", 1)["x"], "ARRAY"))
        wrapper = _is(F.col("v"), "OBJECT") & ~mapped(F.col("v"), F.col("e")) & F.when(F.size("e") > 0, one).otherwise(False)
        each = held.select("batch", "top", "at", listed.alias("listed"), wrapper.alias("wrapper"), F.posexplode("e").alias("p", "y")).select(
            "batch", "top", "listed", "wrapper", F.concat("at", F.array(F.col("p").cast("int"))).alias("at"), F.col("y.k").alias("k"), F.col("y.x").alias("x")
        )
        own = F.coalesce(*[F.try_variant_get("x", f"$.{i}", "string") for i in ids])
        each = each.where(~F.col("listed") | _is(F.col("x"), "OBJECT")).select("*", F.when(F.col("listed"), own).otherwise(F.col("k")).alias("id"), F.when(F.col("listed"), _entries(F.col("x"))).alias("inner"))
        hit = (F.col("listed") & F.col("id").isNotNull()) | (~F.col("listed") & ~F.col("wrapper"))
        inside = ~hit & F.col("listed") & mapped(F.col("x"), F.col("inner"))
        naked = ~hit & ~inside & F.col("listed") & holds(F.col("x"))
        each = checkpointed(each.select("*", hit.alias("hit"), inside.alias("inside"), naked.alias("naked")))
        maps = each.where("inside").select("batch", "at", F.posexplode("inner").alias("p", "y")).select("batch", F.concat("at", F.array(F.col("p").cast("int"))).alias("at"), F.col("y.k").alias("id"), F.col("y.x").alias("x"))
        now = each.where("hit").select("batch", "at", "id", "x").unionByName(maps).select("batch", "at", F.col("id").try_cast("long").alias("article_id"), F.to_json("x").alias("value")).where("article_id IS NOT NULL")
        alone = each.where("naked AND top").select("batch", "at", F.to_json("x").alias("value"))
        found, bare = (now, alone) if found is None else (found.unionByName(now), bare.unionByName(alone))
        deeper = each.where("NOT hit AND NOT inside AND NOT naked")
        level = deeper.select("batch", F.col("x").alias("v"), "at", (F.col("top") & F.col("wrapper")).alias("top"))
    if found is None:
        return raw.sparkSession.createDataFrame([], raw.select("batch").schema.add("article_id", "long").add("value", "string"))
    named = found.groupBy("batch", "article_id").agg(F.max_by("value", "at").alias("value"))
    if asked is None:
        return named
    # Contents without ids: only where the answer has no other row, and as many as were asked.
    of = Window.partitionBy("batch")
    ranked = asked.select("batch", "article_id", F.row_number().over(of.orderBy("seq")).alias("k"), F.count("*").over(of).alias("n"))
    placed = bare.join(named.select("batch").distinct(), "batch", "left_anti").select("batch", "value", F.row_number().over(of.orderBy("at")).alias("k"), F.count("*").over(of).alias("n"))
    return named.unionByName(placed.join(ranked, ["batch", "k", "n"]).select("batch", "article_id", "value"))


def last_titles(links: DataFrame) -> DataFrame:
    """(link, title): of each raw link of a ledger the title of its last line. links: (line_no, link, title, …)."""
    return links.groupBy("link").agg(F.max_by("title", "line_no").alias("title"))


def flags(raw: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch, article_id) that annotators' lists (batch, text) flag: whole numbers that were asked in the batch, each once."""
    each = raw.select("batch", F.explode(F.from_json("text", "array<string>")).alias("x"))
    return each.select("batch", F.col("x").try_cast("long").alias("article_id")).distinct().join(asked.select("batch", "article_id"), ["batch", "article_id"], "left_semi")


def unusable(raw: DataFrame, asked: DataFrame | None = None, ids: tuple[str, ...] = ID_FIELDS, content: tuple[str, ...] = CONTENT_FIELDS) -> DataFrame:
    """(shape, n) of answers (batch, text) that gave no row: ``none`` if they don't parse, else object, array, string, number, boolean or null, with the first keys of objects,
    and of a list its length and what its first item is. A batch has one answer."""
    left = raw.join(answers(raw, asked, ids, content).select("batch").distinct(), "batch", "left_anti").select(json_value(F.col("text")).alias("v"))

    def kind(v: Column) -> Column:
        k = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        return F.when(k.isin("BIGINT", "DECIMAL", "DOUBLE"), "number").when(k == "VOID", "null").otherwise(F.lower(k))

    keys = lambda v: F.array_join(F.slice(F.transform(_entries(v), lambda e: e["k"]), 1, 8), ",")
    told = lambda v: F.when(_is(v, "OBJECT"), F.concat(F.lit("object "), keys(v))).otherwise(kind(v))
    first = F.get(_entries(F.col("v")), F.lit(0))["x"]
    listed = F.when(F.size(_entries(F.col("v"))) == 0, "array 0").otherwise(F.concat(F.lit("array "), F.size(_entries(F.col("v"))).cast("string"), F.lit(" of "), told(first)))
    shape = F.when(F.col("v").isNull(), "none").when(_is(F.col("v"), "ARRAY"), listed).otherwise(F.trim(told(F.col("v"))))
    return left.select(shape.alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
