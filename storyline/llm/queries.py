"""Registered queries of the training-data operators, each over its whole table, and the same results in SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality_rules, secret_scan, warc_zip, weak_labels
from .common import words
from .embedding import near_vectors
from .language import with_languages
from .mixing import Mix, mixed
from .oracles import ORACLE_SQL as ORACLE_SQL
from .packing import packed_pieces
from .prefix_trie import prefix_trie
from .simhash import near_duplicates
from .substring import remove_repeats
from .whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_words = F.size(words(F.col("text")))
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), tokens=n_words, mix=Mix(entropy=0.95, max_repeats=3.0))
    return out.select("doc_id", "source", "mix_pass", "mix_block", "mix_order", "mix_tokens")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.scored(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_languages(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc_zip": op2_warc_zip,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_embedding": op8_embedding,
    "op9_weak_labels": op9_weak_labels,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}

