"""State tables: partitioned by day, replaced by day, pruned by day. Every write is idempotent for its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def write_day(df: DataFrame, path: str) -> None:
    """Replace the partitions of the days that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows with first <= day < last; other partitions aren't read."""
    return spark.read.parquet(path).where((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.lit(last).cast("date")))


def upserted(history: DataFrame, today: DataFrame, day: Column, keep_days: int, clip: dict[str, int]) -> DataFrame:
    """A history with today's rows in place of what it had for ``day``, without days before ``day - keep_days``; long columns clipped."""
    new = today.withColumns({c: F.substring(c, 1, n) for c, n in clip.items()})
    old = history.where((F.col("day") != day) & (F.col("day") >= F.date_sub(day, keep_days)))
    return old.unionByName(new.select(old.columns))


def upserted_days(history: DataFrame, new: DataFrame, day: Column, keep_days: int, clip: dict[str, int]) -> DataFrame:
    """As ``upserted`` for new rows (day, article_id, pos, …) of any days: each replaces what the history has for it, an article counts once, at its first place."""
    first = new.groupBy("day", "article_id").agg(F.min_by(F.struct(*[c for c in history.columns if c not in ("day", "article_id")]), "pos").alias("x"))
    rows = first.select("day", "article_id", "x.*").withColumns({c: F.substring(c, 1, n) for c, n in clip.items()})
    both = history.join(new.select("day").distinct(), "day", "left_anti").unionByName(rows)
    return both.where((F.col("day") <= day) & (F.col("day") >= F.date_sub(day, keep_days)))


def appended_ledger(ledger: DataFrame, pending: DataFrame, today: Column, published: bool, keep_days: int = 7) -> DataFrame:
    """The seen-link ledger after a run: pending rows of today join it if the report was published; stale pending rows and old days go."""
    rows = pending.where((F.col("day") == today) & (F.coalesce("link", F.lit("")) != ""))
    rows = rows.withColumns({"link": collapse(F.col("link")), "title": collapse(F.col("title"))})
    both = ledger.unionByName(rows.select(ledger.columns)) if published else ledger
    return both.where(F.col("day") >= F.date_sub(today, keep_days))


def pool(articles: DataFrame, by: list[str]) -> DataFrame:
    """Articles with text, numbered from 1 in order."""
    return articles.where("success AND word_count > 0").withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))


def newest(log: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The ``most`` newest rows of a log; only that many reach one task."""
    return log.orderBy(*order).limit(most)


def kept_report(old_published: Column, old_count: Column, new_count: Column) -> Column:
    """Whether a new report may replace the old one: not if that is published and longer."""
    return ~(old_published & (old_count > new_count))


def reset_day(tables: list[DataFrame], day: Column) -> list[DataFrame]:
    return [t.where(F.col("day") != day) for t in tables]


def staged(items: DataFrame, today: Column) -> DataFrame:
    """Links of today's run that wait for its report: (day, link, title, description) of rows with a link."""
    return items.where((F.col("day") == today) & (F.coalesce("link", F.lit("")) != "")).select("day", "link", "title", "description")


def archived(archive: DataFrame, today: DataFrame, most: int = 43) -> DataFrame:
    """An archive (day, article_id, pos, is_headline) with today's rows, numbered through: headlines first, then ``most`` body rows; days that it has stay as they are."""
    new = today.join(archive.select("day").distinct(), "day", "left_anti")
    both = archive.unionByName(new.select(archive.columns))
    ranked = both.withColumn("_k", F.row_number().over(Window.partitionBy("day", "is_headline").orderBy("pos"))).where(F.col("is_headline") | (F.col("_k") <= most))
    return ranked.withColumn("number", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("is_headline"), "pos"))).drop("_k")


def appended_log(log: DataFrame, new: DataFrame, now: Column, days: int) -> DataFrame:
    """A log (ts, …) with new rows and without those older than ``days``."""
    return log.unionByName(new).where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def retained(reports: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """(day): days of reports that are kept, those of the last ``days`` that exist."""
    return reports.select("day").distinct().where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))
