"""Whitening of embeddings by the covariance of distinct vectors weighted by how often they occur.

Entries become whole numbers, x = floor(scale * c) + shift; equal x vectors are one row with a weight, the number of its copies (or one, to fit on
distinct vectors). Sums are exact. The covariance is a sum of weighted products of centred rows, one matrix for each task, added up row by row; what
reaches the driver is one matrix for each length of vector, however many vectors there are. Each distinct vector is whitened once and joined to
its copies by a digest, in a join that Spark can split where a vector has very many copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_dicts, arrow_rows, shared_dir

#: Components of an eigenvalue below this share of the largest are noise of rounding: the vectors don't span them.
RANK = 1e-12
#: Entries of all covariances together, a bound on what the driver holds: a length of 5,792, or many lengths below.
MOST_CELLS = 1 << 25
SUM_ROW = "dim int, i int, total string, n long"
MATRIX_ROW = "dim int, i int, row binary"
WHITE = "digest binary, dim int, deviation string, whitened doubles"


class Model(NamedTuple):
    """Of vectors of one length: how many are fitted, whole means and what is left of them, components, and their eigenvalues over the trace."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    roots: np.ndarray
    explained: np.ndarray


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(length, x of each class, weights, digests), some classes of one length at a time."""
    held: dict[int, list[dict]] = {}
    for r in arrow_dicts(batches, 1024):
        own = held.setdefault(len(r["x"]), [])
        own.append(r)
        if len(own) * max(1, len(r["x"])) >= 1 << 18:
            yield len(r["x"]), *_stacked(held.pop(len(r["x"])))
    for dim, own in held.items():
        yield dim, *_stacked(own)


def _stacked(own: list[dict]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return np.array([r["x"] for r in own], np.int64), np.array([r["weight"] for r in own], np.int64), [r["digest"] for r in own]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        total: dict[int, list] = {}
        for dim, x, w, _ in _rows(batches):
            if int(np.abs(x).max()) * int(w.sum()) >= 1 << 62:
                x, w = x.astype(object), w.astype(object)  # Python's numbers, of any size
            own = total.setdefault(dim, [np.zeros(dim, object), 0])
            own[0] = own[0] + (w @ x).astype(object)
            own[1] += int(w.sum())
        for dim, (s, n) in total.items():
            yield from ((dim, i, str(v), n) for i, v in enumerate(s))

    yield from arrow_rows(rows(), SUM_ROW)


def _centred(x: np.ndarray, low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less its mean; the whole part is taken off in whole numbers, so that nothing is lost however far the vectors are from zero."""
    return (x - low).astype(np.float64) - rest


def _products(means: dict[int, tuple[int, np.ndarray, np.ndarray]], models: dict[int, Model] | None = None):
    """Weighted sums of products of centred rows, a row of the matrix at a time; with ``models``, of whitened rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            total: dict[int, np.ndarray] = {}
            for dim, x, w, _ in _rows(batches):
                v = _centred(x, *means[dim][1:])
                if models:
                    v = _whitened(v, models[dim])
                part = (v * w[:, None]).T @ v
                total[dim] = total[dim] + part if dim in total else part
            for dim, m in total.items():
                yield from ((dim, i, row.tobytes()) for i, row in enumerate(m))

        yield from arrow_rows(rows(), MATRIX_ROW)

    return each


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by length and place; the parts of one are added up as they come."""

    def rows() -> Iterator[tuple]:
        at, total = None, None
        for r in arrow_dicts(batches):
            row = np.frombuffer(r["row"], np.float64)
            if at == (r["dim"], r["i"]):
                total = total + row
                continue
            if at:
                yield *at, total.tobytes()
            at, total = (r["dim"], r["i"]), row
        if at:
            yield *at, total.tobytes()

    yield from arrow_rows(rows(), MATRIX_ROW)


def _matrices(classes: DataFrame, products) -> dict[int, np.ndarray]:
    """The matrix of each length of vector."""
    parts = classes.mapInArrow(products, MATRIX_ROW).repartition("dim", "i").sortWithinPartitions("dim", "i").mapInArrow(_added, MATRIX_ROW)
    held: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():
        held.setdefault(r["dim"], {})[r["i"]] = np.frombuffer(bytes(r["row"]), np.float64)
    return {dim: np.stack([own[i] for i in range(len(own))]) for dim, own in held.items()}


def _components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit eigenvectors as rows, by falling eigenvalue; their roots; eigenvalues over the trace); the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    kept = min(most, int((values > RANK * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    vectors = vectors[:kept]
    if kept:
        vectors = vectors * np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(1)])[:, None]
    return vectors, np.sqrt(values[:kept]), values[:kept] / np.trace(v) if kept else values[:0]


def _whitened(v: np.ndarray, model: Model) -> np.ndarray:
    return v @ model.components.T / model.roots


def _deviation(x: np.ndarray, n: int, low: np.ndarray, rest: list[int]) -> np.ndarray:
    """Sum of (n * x - S)^2 for each row, exact; S is n * low + rest."""
    d = x - low
    if x.shape[1] * (n * (int(np.abs(d).max()) + 1)) ** 2 >= 1 << 62:
        d, rest = d.astype(object), np.array(rest, object)
    return ((n * d - rest) ** 2).sum(1)


def _white(models: dict[int, Model], rests: dict[int, list[int]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for dim, x, _, digests in _rows(batches):
                m = models[dim]
                white = _whitened(_centred(x, m.low, m.rest), m)
                for digest, deviation, w in zip(digests, _deviation(x, m.n, m.low, rests[dim]), white.tolist(), strict=True):
                    yield digest, dim, str(deviation), w

        yield from arrow_rows(rows(), WHITE)

    return each


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, components: int = 32, weights: str = "count",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row that has a vector, and each component, from 1.

    deviation: sum of (n * x - S)^2 as decimal(38,0), exact; null if it has more digits. weights: ``count`` fits on all rows, ``one`` on distinct vectors. Rows are left out
    whose vector is null or holds entries that are null, not finite or too large for x to be a long. Vectors of different lengths have
    nothing in common: each length is fitted by itself, and n, components and the error are its own. Directions in which the vectors don't differ are no
    components, so equal vectors only, a single one, or vectors without entries have no rows. Repeated rows and null ids come out
    as often as they came in; other columns, whatever their names, are left out. No rows: no rows.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights: count or one")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: F.coalesce(F.abs(c) * scale < 2.0**62, F.lit(False)))  # NaN is larger than any number
    held = given.where(F.col("v").isNotNull() & fits).select("id", F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift)).alias("x"))
    keyed = held.select("id", "x", F.unhex(F.md5(F.array_join("x", ",").cast("binary"))).alias("digest"))
    distinct = keyed.groupBy("x", "digest").agg(F.count("*").alias("copies"))
    folder = f"{shared_dir(vectors.sparkSession)}/whitening-{uuid4().hex}"
    distinct.select("x", "digest", (F.col("copies") if weights == "count" else F.lit(1).cast("long")).alias("weight")).write.parquet(folder)
    classes = vectors.sparkSession.read.parquet(folder)

    some = classes.where(F.size("x") > 0)
    added = some.mapInArrow(_sums, SUM_ROW).groupBy("dim", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    totals: dict[int, dict[int, int]] = {}
    counts: dict[int, int] = {}
    for r in added.collect():  # a row for each entry of each length
        totals.setdefault(r["dim"], {})[r["i"]] = int(r["total"])
        counts[r["dim"]] = r["n"]
    if sum(d * d for d in totals) > MOST_CELLS:
        raise ValueError(f"covariances of {len(totals)} lengths have over {MOST_CELLS} entries; whiten each length by itself")
    parts = {d: [divmod(own[i], counts[d]) for i in range(d)] for d, own in totals.items()}
    means = {d: (counts[d], np.array([a for a, _ in p], np.int64), np.array([b / counts[d] for _, b in p])) for d, p in parts.items()}
    models = {d: Model(*means[d], *_components(v / means[d][0], components)) for d, v in _matrices(some, _products(means)).items()} if means else {}
    models = {d: m for d, m in models.items() if len(m.roots)}
    shown = some.where(F.size("x").isin(list(models))) if models else some.where("false")
    errors = {d: float(np.abs(c / models[d].n - np.eye(len(c))).max()) for d, c in _matrices(shown, _products(means, models)).items()} if models else {}

    rests = {d: [b for _, b in parts[d]] for d in models}
    white = shown.mapInArrow(_white(models, rests), WHITE.replace("doubles", "array<double>"))
    # By a hash beside the digest: then both sides are dealt for this join alone, and Spark can split the rows of a vector that has very many.
    mine = keyed.select("id", "digest", F.xxhash64("digest").alias("h"))
    both = mine.join(white.withColumn("h", F.xxhash64("digest")).hint("shuffle_merge"), ["h", "digest"])
    facts = vectors.sparkSession.createDataFrame(
        [(d, k + 1, m.n, float(e), errors[d]) for d, m in models.items() for k, e in enumerate(m.explained)], "dim int, component int, n long, explained double, identity_error double"
    )  # `components` rows for each length
    each = both.select("id", "dim", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    out = each.withColumn("component", F.col("k") + 1).join(F.broadcast(facts), ["dim", "component"])
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
