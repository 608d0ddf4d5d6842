"""Language identification by the nearest of several centroids per language, over TF-IDF vectors of hashed character n-grams.

A text in small letters, all that isn't a letter being one blank, is counted as n-grams of one to three characters in ``WIDTH`` buckets, a
window of the text at a time. Counts are damped by a logarithm, weighted by inverse document frequency and brought to unit length. Each language's
vectors are clustered into some centroids by spherical k-means; a text has the language of the centroid of largest cosine. Beyond the centroid's radius,
the distance that few of its own texts exceed, a text is rejected. The fit reads a bounded sample of labelled texts; all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_dicts, arrow_rows, checkpointed

#: Buckets of n-grams; labelled texts of each language that are fitted on, about; languages at most, the most frequent ones; centroids of each at most.
WIDTH, SAMPLE, LANGUAGES, CENTROIDS = 1 << 13, 1500, 1000, 4
#: Characters counted at a time.
WINDOW = 1 << 16
#: A centroid's radius: this quantile of its own texts' distances, times the slack, and at least as much as a text of few copies needs.
QUANTILE, SLACK, LEAST_RADIUS, ROUNDS = 0.98, 1.25, 0.1, 25
UNKNOWN = "und"
COUNTED = "lang string, at ints, counts ints"
NEAREST = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


class Model(NamedTuple):
    """Weights of buckets, and unit centroids with their languages and radii."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    radii: np.ndarray


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str, width: int = WIDTH) -> np.ndarray:
    """How many n-grams of one to three characters of the whole text fall into each bucket."""
    out = np.zeros(width, np.int64)
    last = np.array([32, 32], np.uint64)  # the two characters before the window
    for k in range(0, len(text), WINDOW):
        c = np.frombuffer(text[k : k + WINDOW].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, 32).astype(np.uint64)
        c = np.concatenate([last, c])
        keep = np.ones(len(c), bool)
        keep[2:] = (c[2:] != 32) | (c[1:-1] != 32)  # blanks in a row are one
        c = c[keep]
        if len(c) > 2:
            two = c[1:-1] << np.uint64(21) | c[2:]
            for n, g in enumerate((c[2:], two, c[:-2] << np.uint64(42) | two)):
                h = (g + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                # An n-gram ends in this window, so that windows count each once.
                out += np.bincount((h >> np.uint64(40)).astype(np.int64) % width, minlength=width)
            last = c[-2:]
    return out


def _unit(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(idf), np.float32)
    v[at] = (1 + np.log(counts)) * idf[at]
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _counted(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for r in arrow_dicts(batches, 64):
                n = ngrams(r["text"], width)
                at = np.flatnonzero(n)
                yield r["lang"], at.tolist(), np.minimum(n[at], 1 << 30).tolist()

        yield from arrow_rows(rows(), COUNTED, 500)

    return each


def _clustered(idf: np.ndarray, k: int):
    """Centroids of one language's sample by spherical k-means; starts spread out, each the text least like those before."""

    def each(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["at", "counts"], key=lambda c: c.map(tuple))
        v = np.stack([_unit(np.asarray(a, int), np.asarray(n, float), idf) for a, n in zip(own["at"], own["counts"], strict=True)])
        mean = v.mean(0)
        start = [int((v @ mean).argmax())]
        while len(start) < min(k, len(v)):
            near = (v @ v[start].T).max(1)
            if near.min() > 1 - 1e-6:
                break
            start.append(int(near.argmin()))
        c, own_of = v[start], None
        for _ in range(ROUNDS):
            now = (v @ c.T).argmax(1)
            if own_of is not None and (now == own_of).all():
                break
            own_of = now
            for j in range(len(c)):
                m = v[own_of == j].sum(0)
                c[j] = m / np.linalg.norm(m) if np.linalg.norm(m) else c[j]
        cos = v @ c.T
        own_of, far = cos.argmax(1), 1 - cos.max(1)
        used = [j for j in range(len(c)) if (own_of == j).any()]
        radius = [max(LEAST_RADIUS, SLACK * float(np.quantile(far[own_of == j], QUANTILE))) for j in used]
        return pd.DataFrame({"lang": [own["lang"].iloc[0]] * len(used), "cluster": used, "centroid": [c[j].astype(np.float32).tobytes() for j in used], "radius": radius})

    return each


def fit(
    docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES, centroids: int = CENTROIDS, width: int = WIDTH,
) -> Model:
    """The model of the texts of ``docs`` that are ``learned`` from and have a language and a letter.

    Of each of the ``languages`` most frequent ones, texts are taken whose hash of id and text falls below ``sample`` in as many rows as it has: about
    ``sample`` different ones at most.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(learned, F.lit(False)).alias("own"))
    some = given.where("own AND lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("id", "text"))
    n = some.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = docs.sparkSession.createDataFrame(n, "lang string, n long")
    taken = some.join(F.broadcast(counts), "lang").where(F.pmod("h", F.col("n")) < sample).where(F.col("text").rlike(r"\p{L}")).dropDuplicates(["lang", "h"]).select("lang", "text")
    counted = checkpointed(taken.mapInArrow(_counted(width), COUNTED.replace("ints", "array<int>")))
    df = counted.select(F.explode("at").alias("b")).groupBy("b").agg(F.count("*").alias("df"))
    n_texts = counted.count()
    idf = np.full(width, np.log(1 + n_texts) + 1, np.float32)
    for r in df.collect():  # ``width`` rows at most
        idf[r["b"]] = np.log((1 + n_texts) / (1 + r["df"])) + 1
    found = counted.groupBy("lang").applyInPandas(_clustered(idf, centroids), "lang string, cluster int, centroid binary, radius double")
    rows = sorted(found.collect(), key=lambda r: (r["lang"], r["cluster"]))  # some rows for each language of the sample
    c = np.stack([np.frombuffer(bytes(r["centroid"]), np.float32) for r in rows]) if rows else np.zeros((0, width), np.float32)
    return Model(idf, [r["lang"] for r in rows], c, np.array([r["radius"] for r in rows]))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """(id, others, lang_pred, score, rejected) of each row: the language of the nearest centroid, its cosine from 0 to 1, and whether it is too far.

    A null text and one without letters is ``und`` with a score of 0, not rejected; so are all texts if the model learned nothing. Equal texts get the same result; a tie goes to the
    language that is first in the alphabet. Repeated rows and null ids come out as often as they came in. Columns but ``others`` are left out. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids of the sample's languages

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def one(t: str | None) -> tuple[str, float, bool]:
            if t is None or not m.langs:
                return UNKNOWN, 0.0, False
            n = ngrams(t, len(m.idf))
            at = np.flatnonzero(n)
            cos = m.centroids @ _unit(at, n[at].astype(float), m.idf)
            j = int(cos.argmax())
            return m.langs[j], float(min(1.0, max(0.0, cos[j]))), bool(1 - cos[j] > m.radii[j])

        for batch in batches:
            if batch.num_rows:
                lang, score, far = zip(*(one(t.as_py()) for t in batch.column(batch.num_columns - 1)), strict=True)
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    kept = docs.select(F.col(id_col).alias(id_col), *others)
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    schema = T.StructType([*kept.schema.fields, *NEAREST.fields])
    return docs.select(F.col(id_col).alias(id_col), *others, text.alias("_text")).mapInArrow(nearest, schema)


def with_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of each row; learned from rows whose CRC-32 of the id leaves another rest than ``held_out``.

    A null id has no rest: its row is neither held out nor learned from.
    """
    apart = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out
    model = fit(docs, ~apart, id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"), F.coalesce(apart, F.lit(False)).alias("held_out"))
    return identified(own, model, id_col, "_text", "held_out")
