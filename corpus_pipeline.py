"""A corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which the next one reads from Parquet. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import shared_dir, words
from storyline.llm.mixing import Mix, mixed
from storyline.llm.packing import packed_pieces
from storyline.llm.quality_rules import cleaned
from storyline.llm.secret_scan import redacted
from storyline.llm.simhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that are too frequent at their source."""
    return cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources up to twice, to the weights of the mix."""
    return mixed(docs, tokens=F.size(words(F.col("text"))), mix=Mix(max_repeats=2.0)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packed_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SimHash and tokens are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
