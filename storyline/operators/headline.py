"""Editing a report's headlines: guards, label checks, replacements and an editor's swaps. ``by`` are the columns of one report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import fact_tokens
from .ranking import DIMENSIONS, categories, replacement


def signal_guard(picks: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """(…, slot, article_id): picks without a signal give way, in order, to the pool's unused rows with one; where those run out they stay.

    picks: (…, slot, article_id, has_signal); pool: (…, rank, article_id, has_signal).
    """
    w = Window.partitionBy(*by)
    weak = picks.where("NOT has_signal").withColumn("_k", F.row_number().over(w.orderBy("slot"))).select(*by, "slot", "_k")
    free = pool.where("has_signal").join(picks.select(*by, "article_id"), [*by, "article_id"], "left_anti")
    free = free.withColumn("_k", F.row_number().over(w.orderBy("rank"))).select(*by, "_k", F.col("article_id").alias("_new"))
    swap = weak.join(free, [*by, "_k"]).select(*by, "slot", "_new")
    return picks.join(swap, [*by, "slot"], "left").select(*by, "slot", F.coalesce("_new", "article_id").alias("article_id"))


def enforced_labels(rows: DataFrame, state_evidence: Column, spyware_evidence: Column) -> DataFrame:
    """Scored rows whose labels their texts bear out: exploitation by a state and spyware become routine vulnerabilities without evidence, and count anew;
    a state actor without evidence keeps its label and loses its priority. Adds ``downgraded`` and ``unverified``."""
    no_state, no_spy = ~F.coalesce(state_evidence, F.lit(False)), ~F.coalesce(spyware_evidence, F.lit(False))
    down = ((F.col("category") == "zafiyet_aktif_apt") & no_state) | ((F.col("category") == "casus_yazilim") & no_spy)
    held = rows.withColumn("downgraded", down).withColumn("unverified", (F.col("category") == "nation_state_apt") & no_state)
    held = held.withColumn("category", F.when(F.col("downgraded"), "zafiyet_rutin").otherwise(F.col("category")))
    return retotalled(held)


def retotalled(rows: DataFrame) -> DataFrame:
    """Scored rows with the category's columns and total that follow from ``category``."""
    own = rows.drop("priority", "headline_ok", "is_vuln", "no_points", "total").join(F.broadcast(categories(rows.sparkSession)), "category")
    return own.withColumn("total", F.when(F.col("cyber_gate") & ~F.col("no_points"), sum((F.col(d) for d in DIMENSIONS), F.lit(0))).otherwise(0))


def verified_duplicates(rows: DataFrame, strongest: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows whose ``dup_flag`` holds only if their strongest relation to history is ``same``. strongest: (id, relation)."""
    known = strongest.select(F.col("id").alias(key), "relation")
    return rows.join(known, key, "left").withColumn("dup_flag", F.col("dup_flag") & F.coalesce(F.col("relation") == "same", F.lit(False)))


def replaced_within(picks: DataFrame, pool: DataFrame, conflicts: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """(…, slot, article_id): a pick that tells the same as an earlier one is replaced by the first of the pool that tells of nothing kept, if there is one.

    picks: (…, slot, article_id), slots from 1 to ``n``; pool: (…, rank, article_id); conflicts: (article_id, other), both ways round.
    """
    kept = picks.where("slot = 1").select(*by, "slot", "article_id")
    spare = pool.join(picks.select(*by, "article_id"), [*by, "article_id"], "left_anti")
    for k in range(2, n + 1):
        own = picks.where(F.col("slot") == k).select(*by, "slot", "article_id")
        hit = own.join(conflicts, "article_id").join(kept.select(*by, F.col("article_id").alias("other")), [*by, "other"]).select(*by, F.lit(True).alias("_hit")).distinct()
        new = replacement(spare, kept, conflicts, by).select(*by, F.col("article_id").alias("_new"))
        chosen = F.when(F.col("_hit"), F.coalesce("_new", "article_id")).otherwise(F.col("article_id"))
        kept = kept.unionByName(own.join(hit, by, "left").join(new, by, "left").select(*by, "slot", chosen.alias("article_id")))
    return kept


def category_fixes(rows: DataFrame, fixes: DataFrame, key: str = "article_id") -> DataFrame:
    """Scored rows with an editor's categories, where those exist and differ, counted anew; ``was`` has the old one. fixes: (article_id, category)."""
    new = fixes.where(F.col("category").isin(list(lx.CATEGORIES))).select(key, F.col("category").alias("_new"))
    held = rows.join(new, key, "left").withColumn("was", F.when(F.col("_new") != F.col("category"), F.col("category")))
    return retotalled(held.withColumn("category", F.coalesce("_new", "category")).drop("_new"))


def editor_swaps(proposed: DataFrame, headlines: DataFrame, body: DataFrame, banned: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """(…, pos, down, up, action) of each proposed swap: done, refused with a reason, or void.

    proposed: (…, pos, down, up), in order; headlines, body: (…, article_id, total, priority, headline_ok); banned: (…, article_id). A swap is void if ``down``
    is no headline or ``up`` no body row by then, refused if ``up`` is banned, of a category that can't be a headline, or weaker both in points and in
    priority. At most ``most`` are done. A group is what an editor proposes for one report; the report's rows aren't in it.
    """
    told = lambda rows, c: rows.select(*by, F.col("article_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("total", "priority", "headline_ok")])
    columns = [*by, "article_id", "total", "priority", "headline_ok"]
    rows = headlines.select(*columns, F.lit("headline").alias("section")).unionByName(body.select(*columns, F.lit("body").alias("section")))
    held = proposed
    for c in ("down", "up"):
        held = held.join(told(rows, c).join(rows.select(*by, F.col("article_id").alias(c), F.col("section").alias(f"{c}_in")), [*by, c]), [*by, c], "left")
    held = held.join(banned.select(*by, F.col("article_id").alias("up"), F.lit(True).alias("banned")).distinct(), [*by, "up"], "left")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        place: dict[int, str] = {}
        for x in group.itertuples():
            place[x.down], place[x.up] = x.down_in, x.up_in
        done, out = 0, []
        for x in group.sort_values("pos").itertuples():
            if done >= most or place[x.down] != "headline" or place[x.up] != "body":
                action = "void"
            elif x.banned is True:
                action = "banned"
            elif not x.up_headline_ok:
                action = "category"
            elif x.up_total < x.down_total and x.up_priority < x.down_priority:
                action = "weaker"
            else:
                action, done = "done", done + 1
                place[x.down], place[x.up] = "body", "headline"
            out.append((*[getattr(x, b) for b in by], x.pos, x.down, x.up, action))
        return pd.DataFrame(out, columns=[*by, "pos", "down", "up", "action"])

    kinds = dict(proposed.dtypes)
    return held.groupBy(*by).applyInPandas(judge, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "pos", "down", "up"]) + ", action string")


def text_fixes(rows: DataFrame, fixes: DataFrame, column: str, key: str = "article_id") -> DataFrame:
    """Rows with an editor's text in ``column`` where it differs and keeps all numbers and ids; ``action`` says what happened. fixes: (article_id, text)."""
    held = rows.join(fixes.select(key, F.trim("text").alias("_new")), key, "left")
    other = F.coalesce((F.col("_new") != "") & (F.col("_new") != F.coalesce(F.col(column), F.lit(""))), F.lit(False))
    action = F.when(~other, "none").when(fact_tokens(F.col(column)) == fact_tokens(F.col("_new")), "applied").otherwise("facts differ")
    return held.withColumn("action", action).withColumn(column, F.when(F.col("action") == "applied", F.col("_new")).otherwise(F.col(column))).drop("_new")
