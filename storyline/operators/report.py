"""Reports as tables of layers: merges, corrections, invariants, audits, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corrected(rows: DataFrame, corrections: DataFrame, columns: list[str], key: str = "article_id") -> DataFrame:
    """Rows with corrected columns, and ``changed``. A correction that calls an item out of scope though its gate is open is refused."""
    sane = corrections.where(~((F.col("category") == "siber_disi") & F.col("cyber_gate"))) if {"category", "cyber_gate"} <= set(corrections.columns) else corrections
    new = sane.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False))
    return joined.withColumn("changed", changed).withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def with_content(rows: DataFrame, content: DataFrame, key: str = "article_id", words: int = 150) -> DataFrame:
    """Rows with out_title and out_body; where there are none, the source's title and first words, flagged."""
    from ..functions.text import first_words

    joined = rows.join(content.select(key, "out_title", "out_body"), key, "left")
    missing = F.col("out_title").isNull()
    return joined.withColumns({"is_fallback": missing, "out_title": F.coalesce("out_title", "title"), "out_body": F.coalesce("out_body", first_words(F.col("src_body"), words))})


def distinct_in_order(rows: DataFrame, by: list[str], key: str = "article_id", pos: str = "pos") -> DataFrame:
    return rows.groupBy(*by, key).agg(F.min(pos).alias(pos))


def reconciled(body: DataFrame, promoted: DataFrame, demoted: DataFrame, by: list[str]) -> DataFrame:
    """Body rows without the promoted, the demoted at their head if not there, renumbered."""
    stay = body.select(*by, "article_id", F.lit(1).alias("_t"), "pos").join(promoted.select(*by, "article_id"), [*by, "article_id"], "left_anti")
    head = demoted.select(*by, "article_id", F.lit(0).alias("_t"), "pos").join(stay.select(*by, "article_id"), [*by, "article_id"], "left_anti")
    return stay.unionByName(head).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("_t", "pos"))).drop("_t")


def violations(layers: DataFrame, banned: DataFrame, by: list[str]) -> DataFrame:
    """(…, layer_no, kind, article_id) of broken invariants.

    layers: (…, layer_no, section, article_id, pos, reason, headline_ok). repeated: an id twice in a section; unexplained: an id that left since the last
    layer without a reason; banned: a banned id newly a headline; category: a headline of a category that can't be one.
    """
    key = [*by, "layer_no"]
    repeated = layers.groupBy(*key, "section", "article_id").count().where("count > 1").select(*key, F.lit("repeated").alias("kind"), "article_id").distinct()
    ids = layers.where("section <> 'dropped'").select(*key, "article_id").distinct()
    last = layers.groupBy(*by).agg(F.max("layer_no").alias("_last"))
    before = ids.join(last, by).where("layer_no < _last").select(*by, (F.col("layer_no") + 1).alias("layer_no"), "article_id")
    told = layers.where("section = 'dropped' AND reason IS NOT NULL").select(*key, "article_id")
    unexplained = before.join(ids, [*key, "article_id"], "left_anti").join(told, [*key, "article_id"], "left_anti").select(*key, F.lit("unexplained").alias("kind"), "article_id")
    head = layers.where("section = 'headline'").select(*key, "article_id", "headline_ok").distinct()
    was = head.select(*by, (F.col("layer_no") + 1).alias("layer_no"), "article_id")
    fresh = head.join(banned.select(*by, "article_id"), [*by, "article_id"], "left_semi").join(was, [*key, "article_id"], "left_anti").select(*key, F.lit("banned").alias("kind"), "article_id")
    category = head.where("NOT headline_ok").select(*key, F.lit("category").alias("kind"), "article_id")
    return repeated.unionByName(unexplained).unionByName(fresh).unionByName(category)


def decisions(layers: DataFrame, by: list[str]) -> DataFrame:
    """The last fate of each id: section, layer and reason."""
    last = F.max_by(F.struct("section", "layer_no", "reason"), F.struct("layer_no", F.when(F.col("section") == "headline", 1).otherwise(0))).alias("x")
    return layers.groupBy(*by, "article_id").agg(last).select(*by, "article_id", "x.section", "x.layer_no", "x.reason")


def source_funnel(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(source, raw, kept, text_ok, pool, status) of each source of the catalogue; items: (source, kept, text_ok, in_pool, seen)."""
    n = lambda c: F.count_if(c)
    found = items.groupBy("source").agg(F.count("*").alias("raw"), n(F.col("kept")).alias("kept"), n(F.col("kept") & F.col("text_ok")).alias("text_ok"), n(F.col("in_pool")).alias("pool"), n(F.col("seen")).alias("seen"))
    every = catalogue.select("source").distinct().join(found, "source", "left").na.fill(0)
    status = (
        F.when(F.col("raw") == 0, "never tried").when(F.col("kept") == 0, "window zero").when(F.col("text_ok") == 0, "extraction zero")
        .when((F.col("pool") == 0) & (F.col("seen") >= F.col("text_ok")), "already reported").when(F.col("pool") == 0, "dedup zero").otherwise("ok")
    )
    return every.withColumn("status", status).drop("seen")


def elimination_funnel(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts from candidates to report, and a map of how many each reason dropped. rows: (…, cyber_gate, total, reported, reason)."""
    out = rows.groupBy(*by).agg(
        F.count("*").alias("candidates"),
        F.count_if("cyber_gate").alias("cyber"),
        F.count_if(F.col("total") > 0).alias("scored"),
        F.count_if("reported").alias("reported"),
        F.count_if(~F.col("reported") & F.col("reason").isNull()).alias("unexplained"),
    )
    dropped = rows.where("reason IS NOT NULL").groupBy(*by, "reason").count().groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("by_reason"))
    return out.join(dropped, by, "left").withColumn("thin", F.col("reported") < 12)


def clean_streak(days: DataFrame) -> DataFrame:
    """(streak): days from the newest back without a dirty one. days: (day, dirty), one row a day at most."""
    last = days.where("dirty").agg(F.max("day").alias("last"))
    return days.join(F.broadcast(last)).where("last IS NULL OR day > last").agg(F.count("*").alias("streak"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame, droppable: str = "same") -> DataFrame:
    """Labels that agree, and decisions that do: only ``droppable`` pairs are dropped."""
    agree: Column = F.col("label") == F.col("predicted")
    policy: Column = (F.col("label") == droppable) == (F.col("predicted") == droppable)
    return pairs.agg(F.count("*").alias("n"), F.count_if(agree).alias("label_ok"), F.count_if(policy).alias("policy_ok"))


def overridden(report: DataFrame, overrides: DataFrame) -> DataFrame:
    """A report (day, section, article_id, pos) after curated overrides (day, op, section, article_id, pos, by_id).

    delete drops rows, replace puts ``by_id`` in a row's place, add puts a row before the one at ``pos``; then rows are renumbered.
    """
    cut = report.join(overrides.where("op = 'delete'").select("day", "section", "article_id"), ["day", "section", "article_id"], "left_anti")
    swap = overrides.where("op = 'replace'").select("day", "section", "article_id", "by_id")
    kept = cut.join(swap, ["day", "section", "article_id"], "left").select("day", "section", F.coalesce("by_id", "article_id").alias("article_id"), F.col("pos").cast("double").alias("pos"))
    new = overrides.where("op = 'add'").select("day", "section", "article_id", (F.col("pos") - 0.5).alias("pos"))
    return kept.unionByName(new).withColumn("pos", F.row_number().over(Window.partitionBy("day", "section").orderBy("pos", "article_id")))


def completed(placed: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """Placements (…, article_id, pos) of ids of the pool, and at their end, in order, the pool's ids (…, article_id, seq) that are placed nowhere."""
    known = placed.join(pool.select(*by, "article_id"), [*by, "article_id"], "left_semi").groupBy(*by, "article_id").agg(F.min("pos").alias("k")).withColumn("_t", F.lit(0))
    rest = pool.join(known.select(*by, "article_id"), [*by, "article_id"], "left_anti").select(*by, "article_id", F.col("seq").alias("k"), F.lit(1).alias("_t"))
    return known.unionByName(rest).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("_t", "k", "article_id"))).drop("_t", "k")


def silent_losses(funnel: DataFrame, reasons: DataFrame) -> DataFrame:
    """(source, alarm) of sources that lose all they bring: no text, or nothing left though not all had been reported. reasons: (source, seen, filtered)."""
    held = funnel.join(reasons.select("source", "seen", "filtered"), "source", "left").na.fill(0, ["seen", "filtered"])
    known = (F.col("filtered") == 0) & (F.col("seen") > 0)
    alarm = F.when((F.col("kept") > 0) & (F.col("text_ok") == 0), "extraction zero").when((F.col("text_ok") > 0) & (F.col("pool") == 0) & ~known, "dedup zero")
    return held.withColumn("alarm", alarm).where("alarm IS NOT NULL").select("source", "alarm")


def grouped_ids(rows: DataFrame, by: list[str], kind: str, most: int = 20, key: str = "article_id") -> DataFrame:
    """(…, kind, n, first): how many rows there are of each kind, and the first ``most`` ids."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by, kind).orderBy(key)))
    return ranked.groupBy(*by, kind).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(key)))).alias("first"))


def feed_freshness(items: DataFrame, now: Column, hours: int = 96, words: int = 100) -> DataFrame:
    """(source, n, in_window, rescuable, newest_hours) of feeds: items in the window, those with a body long enough, hours since the newest. items: (source, ts, n_words)."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 3600
    fresh = F.col("ts").isNull() | (age <= hours)
    return items.groupBy("source").agg(F.count("*").alias("n"), F.count_if(fresh).alias("in_window"), F.count_if(fresh & (F.col("n_words") >= words)).alias("rescuable"), F.min(age).alias("newest_hours"))


def supply(rows: DataFrame, by: list[str], most_share: float = 0.5) -> DataFrame:
    """(…, cyber, dups, fresh, dup_share, relaxed): rows in scope, of which flagged, and whether so many are that the flag is relaxed."""
    out = rows.groupBy(*by).agg(F.count_if("cyber_gate").alias("cyber"), F.count_if(F.col("cyber_gate") & F.col("dup_flag")).alias("dups"))
    share = F.when(F.col("cyber") > 0, F.col("dups") / F.col("cyber")).otherwise(0.0)
    return out.withColumn("fresh", F.col("cyber") - F.col("dups")).withColumn("dup_share", share).withColumn("relaxed", F.col("dup_share") > most_share)


def high_dropped(rows: DataFrame, reported: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """The ``n`` best rows of each report that aren't in it though they are in scope and score above its lowest headline. reported: (…, article_id, section)."""
    lowest = rows.join(reported.where("section = 'headline'").select(*by, "article_id"), [*by, "article_id"], "left_semi").groupBy(*by).agg(F.min("total").alias("lowest"))
    left = rows.where("cyber_gate AND NOT no_points").join(reported.select(*by, "article_id"), [*by, "article_id"], "left_anti").join(lowest, by).where("total > lowest")
    return left.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "article_id"))).where(F.col("k") <= n)


def placements(rows: DataFrame, headlines: DataFrame, best: DataFrame, body: DataFrame, reasons: DataFrame, by: list[str]) -> DataFrame:
    """Scored rows with ``placement`` (headline, top10, body, dropped) and the reason that dropped them."""
    out = rows
    for c, t in (("_h", headlines), ("_t", best), ("_b", body)):
        out = out.join(t.select(*by, "article_id", F.lit(True).alias(c)).distinct(), [*by, "article_id"], "left")
    out = out.withColumn("placement", F.when(F.col("_h"), "headline").when(F.col("_t"), "top10").when(F.col("_b"), "body").otherwise("dropped")).drop("_h", "_t", "_b")
    return out.join(reasons.select(*by, "article_id", "reason"), [*by, "article_id"], "left").withColumn("reason", F.coalesce("reason", F.lit("")))


def headline_trace(layers: DataFrame, by: list[str]) -> DataFrame:
    """(…, layer_no, gone, come): headlines that a layer took out and put in, the k-th with the k-th. layers: (…, layer_no, article_id, pos), headlines only."""
    now = layers.select(*by, "layer_no", "article_id", "pos")
    before = now.withColumn("layer_no", F.col("layer_no") + 1)
    last = now.groupBy(*by).agg(F.max("layer_no").alias("_last"))
    key = [*by, "layer_no", "article_id"]
    first = now.groupBy(*by).agg(F.min("layer_no").alias("_first"))
    gone = before.join(now.select(*key), key, "left_anti").join(last, by).where("layer_no <= _last")
    come = now.join(before.select(*key), key, "left_anti").join(first, by).where("layer_no > _first")
    k = lambda t, c: t.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "layer_no").orderBy("pos", "article_id"))).select(*by, "layer_no", "_k", F.col("article_id").alias(c))
    return k(gone, "gone").join(k(come, "come"), [*by, "layer_no", "_k"], "full").drop("_k")


def report_meta(sections: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """(…, n_items, fresh, least, status) of reports: items, the supply they had, the least number that asks for, and ok or thin. pool: (…, fresh)."""
    from ..functions.predicates import published
    from ..functions.text import floor_of

    out = sections.groupBy(*by).agg(F.count("*").alias("n_items")).join(pool.select(*by, "fresh"), by, "left").withColumn("least", floor_of(F.col("fresh")))
    return out.withColumn("status", published(F.col("n_items"), F.col("least"), F.lit(False)))


def unexplained(candidates: DataFrame, reported: DataFrame, reasons: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that are neither reported nor have a reason."""
    key = [*by, "article_id"]
    return candidates.select(*key).join(reported.select(*key), key, "left_anti").join(reasons.where("reason IS NOT NULL").select(*key), key, "left_anti")


def repaired(before: DataFrame, now: DataFrame, reasons: DataFrame, by: list[str]) -> DataFrame:
    """Body rows (…, article_id, pos) after a layer, each id once, those that left without a reason put back at their head, renumbered."""
    key = [*by, "article_id"]
    once = distinct_in_order(now, by)
    lost = distinct_in_order(before, by).join(once.select(*key), key, "left_anti").join(reasons.where("reason IS NOT NULL").select(*key), key, "left_anti")
    both = once.withColumn("_t", F.lit(1)).unionByName(lost.withColumn("_t", F.lit(0)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("_t", "pos", "article_id"))).drop("_t")


def gaps(days: DataFrame, by: list[str]) -> DataFrame:
    """(…, day, gap): for each day of a report, days since the last one before it; null for the first."""
    own = days.select(*by, "day").distinct()
    return own.withColumn("gap", F.date_diff("day", F.lag("day").over(Window.partitionBy(*by).orderBy("day"))))


def flagged_out(body: DataFrame, flags: DataFrame, enabled: bool = False) -> DataFrame:
    """Body rows without those that an annotator flags as told on earlier days, if that is switched on. flags: (article_id)."""
    return body.join(flags.select("article_id").distinct(), "article_id", "left_anti") if enabled else body


def with_scores(rows: DataFrame, scores: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows with category, gate and total; those without a score count as a breach in scope with one point."""
    out = rows.join(scores.select(key, "category", "cyber_gate", "total"), key, "left")
    return out.withColumns({"category": F.coalesce("category", F.lit("veri_ihlali")), "cyber_gate": F.coalesce("cyber_gate", F.lit(True)), "total": F.coalesce("total", F.lit(1))})
