"""The driver's tables seen as the engine's: articles, scores, feed items; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx

FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them. Asked for as a pattern, as the path of a stream must else be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def joined(a):
    return F.array_join(F.array_sort(a), ",")


def day_of(id_: str):
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col(id_) % 30).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles; the first line is the title, the day follows from the id, the order is that of ids."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), "source", "lang", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("src_body"), day_of("doc_id").alias("day"), F.col("doc_id").alias("seq")
    )


ARTICLES = (
    "a AS (SELECT doc_id AS article_id, source, lang, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS src_body,"
    f" DATE '{FIRST_DAY}' + CAST(doc_id % 30 AS INTEGER) AS day, doc_id AS seq FROM documents)"
)


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as an annotator's raw scores, all strings."""
    s = lambda c: c.cast("string")
    names = F.array(*[F.lit(c) for c in lx.CATEGORIES])
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("article_id"), F.col("doc_id").alias("seq"), "source", day_of("doc_id").alias("day"), F.get(names, (F.col("doc_id") % 13).cast("int")).alias("category"),
        s((F.col("doc_id") % 5 != 0).cast("int")).alias("cyber_gate"), s(F.col("toxic")).alias("dup_flag"), s(F.col("doc_id") % 47).alias("strategic"), s(F.col("n_chars") % 26).alias("impact"),
        s(F.col("doc_id") * 7 % 21).alias("urgency"), s(F.col("quality") * 15).alias("trust"),
    )


_VALUES = ", ".join(f"({k}, '{c}', {p}, {c not in lx.NOT_HEADLINE}, {c in lx.VULNERABILITY}, {c in lx.NO_POINTS})" for k, (c, p) in enumerate(lx.CATEGORIES.items()))
SCORES = (
    f"cat(k, category, priority, headline_ok, is_vuln, no_points) AS (VALUES {_VALUES}), s AS (SELECT d.doc_id AS article_id, d.doc_id AS seq, d.source,"
    f" DATE '{FIRST_DAY}' + CAST(d.doc_id % 30 AS INTEGER) AS day, c.category, c.priority, c.headline_ok, c.is_vuln, c.no_points, d.doc_id % 5 <> 0 AS cyber_gate, l.toxic = 1 AS dup_flag,"
    " least(40, d.doc_id % 47) AS strategic, least(25, d.n_chars % 26) AS impact, least(20, d.doc_id * 7 % 21) AS urgency, least(15, l.quality * 15) AS trust,"
    " CASE WHEN d.doc_id % 5 <> 0 AND NOT c.no_points THEN least(40, d.doc_id % 47) + d.n_chars % 26 + d.doc_id * 7 % 21 + l.quality * 15 ELSE 0 END AS total"
    " FROM documents d JOIN labels l USING (doc_id) JOIN cat c ON c.k = d.doc_id % 13)"
)
ORDER = "total DESC, priority DESC, trust DESC, urgency DESC, seq"
