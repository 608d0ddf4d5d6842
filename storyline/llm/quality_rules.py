"""Quality rules: rules on each text, and lines that many of a host's documents share. DataFrame functions only.

Lines are normalised and hashed; for each host, the distinct documents that hold a line are counted. Lines above the limits are removed, and
documents that keep too little are rejected. Documents are told apart by their text, so that copies of one document count once: they are for
near-duplicate detection to settle, and must not make their own lines look like boilerplate (``Limits.count_copies`` says otherwise). The count goes by host, line and text first,
so that a line that a third of all documents share is summed up by many tasks before it meets in one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, put_back, set_apart, words


@dataclass(frozen=True)
class Limits:
    """A line goes if ``min_docs`` documents of the host or more hold it, and ``enough_docs`` or over ``max_percent`` of the host's documents.

    ``enough_docs`` holds on hosts of any size, so that a line that a small host loses doesn't stay on a large one for its small share.
    A document is depleted if under ``min_words`` words stay, or under ``min_percent`` of its words.
    """

    min_docs: int = 20
    enough_docs: int = 20
    max_percent: int = 10
    min_words: int = 10
    min_percent: int = 50
    max_repeat_percent: int = 20
    #: Whether copies of a text count as documents of their own, told apart by their ids.
    count_copies: bool = False


def repeated_words(w: Column, width: int = 5) -> Column:
    """Words that lie in windows of ``width`` words which the text holds more than once."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            def same(x: Column, k: Column, other: Column) -> Column:
                return F.coalesce(F.get(p, other)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, k, k + 1) | F.when(k > 0, same(x, k, k - 1)).otherwise(False)), lambda x: x["i"]))

        def span(at: Column) -> Column:
            gaps = F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width))))
            return F.aggregate(gaps, F.lit(0), lambda acc, v: acc + v)

        return let(let(placed, twice), span)

    def counted(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - width), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(width)]))
        # Most texts repeat no window; a count of distinct hashes settles those.
        return F.when(F.size(v) >= width, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)

    # Bound here: a filter on the result that is pushed down would otherwise split the text again for each word.
    return let(w, counted).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def normalised(line: Column) -> Column:
    """Lower case, white space as single blanks, digit runs as one 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]+", "0")


def text_rules(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; a null text has no words.

    Other columns stay, whatever their names; those of the six names are replaced.
    """
    limits = limits or Limits()
    own, name = set_apart(docs, text_col)
    text = F.coalesce(F.col(name), F.lit(""))
    held = own.select("*", words(F.col(name)).alias("w"), _lines(F.col(name)).alias("l"))
    out = held.select(
        *own.columns,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all(text, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return put_back(out, docs, **{c: F.col(c) for c in counts}, base_failed=failed)


def _doc(id_: str, text: str, limits: Limits) -> Column:
    """What tells documents apart: the text, so that copies count once, unless ``count_copies``."""
    return F.xxhash64(id_, text) if limits.count_copies else F.xxhash64(text)


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits | None = None) -> DataFrame:
    """(host, line, n_docs): hashes of normalised lines above the limits."""
    limits = limits or Limits()
    keyed = docs.select(F.col(host_col).alias("host"), _doc(id_col, text_col, limits).alias("doc"), F.col(text_col).alias("text"))
    per_host = keyed.groupBy("host").agg(F.countDistinct("doc").alias("n_host"))
    lines = F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(normalised(x))))
    held = keyed.select("host", "doc", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.countDistinct("doc").alias("n_docs"))
    held = held.where(F.col("n_docs") >= limits.min_docs)
    joined = held.alias("l").join(per_host.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    share = 100 * F.col("n_docs") > limits.max_percent * F.col("n_host")
    return joined.where((F.col("n_docs") >= limits.enough_docs) | share).select("l.host", "line", "n_docs")


def _met(own: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, host, doc, pos, n, line) for each line of each document that is too frequent. Repeated rows give repeated lines. own: (id, text, host, doc)."""
    lines = F.transform(_lines(F.col("text")), lambda x: let(normalised(x), lambda y: F.struct(F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n"))))
    each = own.select("id", "host", "doc", F.posexplode(lines).alias("pos", "x")).select("id", "host", "doc", "pos", "x.n", "x.line")
    return each.alias("o").join(frequent.alias("f"), (F.col("o.line") == F.col("f.line")) & F.col("o.host").eqNullSafe(F.col("f.host"))).select("o.*")


def _by_document(found: DataFrame, value: Column, name: str) -> DataFrame:
    return found.groupBy("id", "host", "doc").agg(value.alias(name))


def _joined(docs: DataFrame, more: DataFrame, id_col: str, host_col: str) -> DataFrame:
    on = F.col(f"d.{id_col}").eqNullSafe(F.col("m.id")) & F.col(f"d.{host_col}").eqNullSafe(F.col("m.host")) & (F.col("d.doc") == F.col("m.doc"))
    return docs.alias("d").join(more.alias("m"), on, "left")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits | None = None) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept) for each row.

    Null ids and hosts count as values of their own. Null, empty and blank texts have no words and fail the base rules. Repeated rows come out as often
    as they came in, and count as one document. Very long texts are rated whole. Other columns, whatever their names, are left out. No rows: no rows.
    """
    limits = limits or Limits()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    own = own.withColumn("doc", _doc("id", "text", limits))
    removed = _by_document(_met(own, frequent_lines(own, "id", "text", "host", limits)), F.collect_set(F.struct("pos", "n")), "lines")
    removed = removed.withColumn("gone", F.aggregate("lines", F.lit(0), lambda acc, x: acc + x["n"])).drop("lines")
    rated = text_rules(own, "text", limits).drop("text")
    gone = F.coalesce(F.col("gone"), F.lit(0)).cast("long")
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < limits.min_words) | (100 * left < limits.min_percent * F.col("n_words"))
    out = _joined(rated, removed, "id", "host").select("d.*", gone.alias("n_removed_words")).drop("doc", "host")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumnRenamed("id", id_col)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits | None = None) -> DataFrame:
    """Documents that the rules keep, with all their columns, their text without the lines that are too frequent.

    Nulls, repeated rows and long texts as in ``verdicts``. Other columns stay as they are, whatever their names. No rows: no rows.
    """
    limits = limits or Limits()
    all_, i, t, h = set_apart(docs, id_col, text_col, host_col)
    all_ = all_.withColumn("doc", _doc(i, t, limits))
    own = all_.select(F.col(i).alias("id"), F.col(t).alias("text"), F.col(h).alias("host"), "doc")
    found = _by_document(_met(own, frequent_lines(own, "id", "text", "host", limits)), F.collect_set(F.struct("pos", "n", "line")), "lines")
    lines = found.select("id", "host", "doc", F.aggregate("lines", F.lit(0), lambda acc, x: acc + x["n"]).alias("n_gone"), F.array_distinct(F.transform("lines", lambda x: x["line"])).alias("gone"))
    rated = text_rules(all_, t, limits).where(~F.col("base_failed"))
    out = _joined(rated, lines, i, h)
    left = F.col("n_words") - F.coalesce(F.col("n_gone"), F.lit(0))
    out = out.where((left >= limits.min_words) & (100 * left >= limits.min_percent * F.col("n_words")))
    # A line without a word stays where it is.
    rest = F.array_join(F.filter(F.split(t, "\n", -1), lambda x: ~x.rlike(WORD) | ~F.array_contains(F.col("gone"), F.xxhash64(normalised(x)))), "\n")
    text = F.when(F.col("gone").isNull(), F.col(t)).otherwise(rest)
    return put_back(out.withColumn(t, text), docs)
