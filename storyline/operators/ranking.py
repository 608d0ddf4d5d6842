"""Scores, order and headline choice. Every function takes ``by``, the columns of one report (such as the day), so that many are ranked at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import clamped

DIMENSIONS = list(lx.POINTS)


def categories(spark: SparkSession) -> DataFrame:
    """The categories' table: a fixed, small one."""
    rows = [(c, p, c not in lx.NOT_HEADLINE, c in lx.VULNERABILITY, c in lx.NO_POINTS) for c, p in lx.CATEGORIES.items()]
    return spark.createDataFrame(rows, "category string, priority int, headline_ok boolean, is_vuln boolean, no_points boolean")


def scored(raw: DataFrame) -> DataFrame:
    """Raw score rows with typed, clamped points, the category's columns and ``total``. Unknown categories count as siber_disi.

    raw: (…, category, cyber_gate, dup_flag, strategic, impact, urgency, trust), all strings.
    """
    known = F.when(F.col("category").isin(list(lx.CATEGORIES)), F.col("category")).otherwise("siber_disi")
    truth = lambda c: F.coalesce(F.lower(c).isin("1", "true", "evet"), F.lit(False))
    points = {d: clamped(F.col(d), most) for d, most in lx.POINTS.items()}
    own = raw.withColumns({"category": known, "cyber_gate": truth(F.col("cyber_gate")), "dup_flag": truth(F.col("dup_flag"))} | points)
    joined = own.join(F.broadcast(categories(raw.sparkSession)), "category")
    return joined.withColumn("total", F.when(F.col("cyber_gate") & ~F.col("no_points"), sum((F.col(d) for d in DIMENSIONS), F.lit(0))).otherwise(0))


def effective_priority(priority: Column, verified: Column) -> Column:
    """Actor stories without evidence rank no higher than 4."""
    return F.when(verified, priority).otherwise(F.least(priority, F.lit(4)))


def order(extra: list[Column] | None = None) -> list[Column]:
    return [F.desc("total"), F.desc("priority"), F.desc("trust"), F.desc("urgency"), *(extra or []), F.asc("seq")]


def ranked(rows: DataFrame, by: list[str], extra: list[Column] | None = None, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order(extra))))


def with_rescue(rows: DataFrame, by: list[str], least: int = 6) -> DataFrame:
    """Rows that pass the gate and aren't duplicates, ranked; where those are under ``least``, rescued rows follow, gate-open and with points."""
    ok = F.col("cyber_gate") & ~F.col("dup_flag") & ~F.col("no_points") & (F.col("total") > 0)
    spare = F.col("cyber_gate") & ~F.col("dup_flag") & ~F.coalesce(ok, F.lit(False))
    tier = F.when(ok, 0).when(spare, 1)
    held = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    w = Window.partitionBy(*by)
    held = held.withColumn("n_ok", F.count(F.when(F.col("tier") == 0, 1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("tier", *order())))
    return held.where((F.col("tier") == 0) | (F.col("rank") <= least)).drop("n_ok")


def critique_scope(rows: DataFrame, by: list[str]) -> DataFrame:
    """The 20 best, all actively exploited vulnerabilities, and the ten gate-open rows without points that have the most of them."""
    raw = sum((F.col(d) for d in DIMENSIONS), F.lit(0))
    w = Window.partitionBy(*by)
    zero = F.col("cyber_gate") & (F.col("total") == 0)
    held = rows.withColumn("_top", F.row_number().over(w.orderBy(F.desc("total"), "seq"))).withColumn("_zero", F.row_number().over(w.orderBy(F.when(zero, 0).otherwise(1), F.desc(raw), "seq")))
    return held.where((F.col("_top") <= 20) | (F.col("category") == "zafiyet_aktif_apt") | (zero & (F.col("_zero") <= 10))).drop("_top", "_zero")


def headlines(rows: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """``n`` rows of each report, from the first tier that has any left: eligible and not recent, eligible, vulnerability, any."""
    tier = F.when(F.col("headline_ok") & ~F.col("recent"), 0).when(F.col("headline_ok"), 1).when(F.col("is_vuln"), 2).otherwise(3)
    held = rows.withColumn("tier", tier)
    return held.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("tier", *order()))).where(F.col("slot") <= n)


def soft_gate(rows: DataFrame, by: list[str], passes: Column, least: int = 3) -> DataFrame:
    """Rows that pass; all rows of a report where under ``least`` would stay."""
    n = F.count(F.when(passes, 1)).over(Window.partitionBy(*by))
    return rows.withColumn("_n", n).where(passes | (F.col("_n") < least)).drop("_n")


def executive(rows: DataFrame, by: list[str]) -> DataFrame:
    """Headlines, and the first six of the ten best that aren't vulnerabilities."""
    w = Window.partitionBy(*by)
    body = (F.col("section") == "body") & (F.col("rank") <= 10) & ~F.col("is_vuln")
    held = rows.withColumn("_k", F.row_number().over(w.orderBy(F.when(body, 0).otherwise(1), "rank")))
    return held.where((F.col("section") == "headline") | (body & (F.col("_k") <= 6))).drop("_k")


def numbered(rows: DataFrame, by: list[str], least_regular: int = 5) -> DataFrame:
    """Rows with ``part`` and ``number``: headlines unnumbered, regular items 1 to N, vulnerabilities after them.

    Where under ``least_regular`` items are regular, the best vulnerabilities are counted as regular. Repeated ids of a section keep their first place.
    """
    w = Window.partitionBy(*by)
    once = rows.withColumn("_first", F.row_number().over(Window.partitionBy(*by, "section", "article_id").orderBy("pos"))).where("_first = 1")
    body = F.col("section") == "body"
    once = once.withColumn("_n", F.count(F.when(body & ~F.col("is_vuln"), 1)).over(w)).withColumn("_v", F.row_number().over(w.orderBy(F.when(body & F.col("is_vuln"), 0).otherwise(1), "pos")))
    regular = ~F.col("is_vuln") | (F.col("_v") <= least_regular - F.col("_n"))
    part = F.when(~body, "headline").when(regular, "regular").otherwise("vulnerability")
    named = once.withColumn("part", part)
    rank = F.when(F.col("part") == "headline", 0).when(F.col("part") == "regular", 1).otherwise(2)
    named = named.withColumn("number", F.when(F.col("part") != "headline", F.row_number().over(w.orderBy(rank, "pos")) - F.count(F.when(F.col("part") == "headline", 1)).over(w)))
    return named.drop("_first", "_n", "_v")


def top_signals(signals: DataFrame, quota: dict[str, int], n: int) -> DataFrame:
    """The best of each platform up to its quota (all, if it has none), and of those the ``n`` best. signals: (platform, id, score)."""
    each = signals.withColumn("k", F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("score"), "id")))
    limit = F.coalesce(*[F.when(F.col("platform") == p, F.lit(q)) for p, q in quota.items()], F.lit(1 << 30))
    return each.where(F.col("k") <= limit).orderBy(F.desc("score"), "id").limit(n).drop("k")


def batches(rows: DataFrame, by: list[str], size: int, key: str = "seq") -> DataFrame:
    """Rows with ``batch``: ``size`` at a time in order, for an annotator."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1) / size))


def accepted_answers(asked: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first answer of each id that was asked in the answer's batch, what is to be asked again). answers: (batch, article_id, pos, value)."""
    met = answers.join(asked.select("batch", "article_id"), ["batch", "article_id"], "left_semi")
    first = met.groupBy("batch", "article_id").agg(F.min_by("value", "pos").alias("value"))
    return first, asked.join(first, ["batch", "article_id"], "left_anti")


def rank_inversions(rows: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The ``n`` best body rows of each report that score above its lowest headline and could be headlines."""
    lowest = rows.where("section = 'headline'").groupBy(*by).agg(F.min("total").alias("lowest"))
    over = rows.where("section = 'body' AND headline_ok").join(lowest, by).where("total > lowest")
    return over.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "seq"))).where(F.col("k") <= n)


def replacement(candidates: DataFrame, taken: DataFrame, conflicts: DataFrame, by: list[str]) -> DataFrame:
    """For each report, the first candidate that isn't taken and conflicts with nothing taken. conflicts: (article_id, other)."""
    free = candidates.join(taken.select(*by, "article_id"), [*by, "article_id"], "left_anti")
    hit = conflicts.join(taken.select(*by, F.col("article_id").alias("other")), "other").select(*by, "article_id")
    return free.join(hit, [*by, "article_id"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).where("k = 1").drop("k")
