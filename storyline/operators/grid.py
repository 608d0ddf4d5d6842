"""All pairs of rows of sets, without a row for each pair: rows are packed into chunks, each two chunks meet in one task, and only what is found leaves it.

A row is sent and stored once, as part of its chunk; tasks read the two chunks that they compare. Within a task, the tokens that a row shares with others are
counted over lists of the holders of each token. The counting grows with the square of the rows that hold a token, as the pairs do; none of them is written.
Where a Jaccard is asked for, the most frequent tokens of a row are counted for those rows only that the others leave possible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from io import BytesIO
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpointed

#: Chunks where there are more than ALONE tokens; tokens of a chunk at most; rows that are counted at once.
GROUPS, ALONE, TOKENS, ROWS = 8, 1 << 16, 1 << 23, 1 << 14
#: Of the tokens that similar rows share at least, the part that isn't counted for all; with more of it, short rows can't be told apart.
LEFT = 0.6
#: Holders of a token are in bands of their sizes, which differ by this factor, so that rows too short or too long for a Jaccard aren't counted; bands at most.
BAND, BANDS = 1.5, 32
#: decide(shared, n, m, p, q, later): which rows fit, a value for each and, if need be, a kind. shared(f, g) counts tokens of field f that are in the others' field g (f, if not given),
#: n(f) is the row's size, m(f) are the others'; p and q are the flags; later: which of the others have a larger id. shared.some, likely and of give and take places of rows; then decide may
#: give places of the rows that fit, with a value for each, instead of a mask.
Decide = Callable[..., tuple[np.ndarray, ...]]
#: A chunk: ids, flags, and by field sizes of rows, different tokens in order, and each row's tokens by their place among those.
Chunk = tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _coded(n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    different, codes = np.unique(tokens, return_inverse=True)
    return n.astype(np.int32), different.astype(np.int64), codes.astype(np.uint16 if len(different) <= 1 << 16 else np.uint32)


def _written(chunk: Chunk) -> bytes:
    ids, flags, fields = chunk
    out = BytesIO()
    np.savez(out, ids, flags, *[x for f in fields for x in f])
    return out.getvalue()


def _read(data: bytes) -> Chunk:
    held = np.load(BytesIO(data), allow_pickle=False)
    x = [held[f"arr_{k}"] for k in range(len(held.files))]
    return x[0], x[1], [(x[k], x[k + 1], x[k + 2]) for k in range(2, len(x), 3)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, flags, g, fields …) of a batch as one piece for each group."""
    for batch in batches:
        ids, flags, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fields = [(c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), c.flatten().to_numpy(zero_copy_only=False)) for c in batch.columns[3:]]
        found = []
        for g in np.unique(own).tolist():
            here = own == g
            found.append((g, _written((ids[here], flags[here], [_coded(n[here], tokens[np.repeat(here, n)]) for n, tokens in fields]))))
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["g", "piece"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pieces of a task as one chunk, named by its first id, with its smallest and largest flag."""
    pieces = [_read(p) for batch in batches for p in batch.column("piece").to_pylist()]
    if pieces:
        ids, flags = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
        fields = [_coded(np.concatenate([n for n, _, _ in f]), np.concatenate([different[codes] for _, different, codes in f])) for f in zip(*[p[2] for p in pieces], strict=True)]
        columns = [pa.array([int(v)], pa.int64()) for v in (ids[0], flags.min(), flags.max())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([_written((ids, flags, fields))], pa.binary())], names=["name", "low", "high", "chunk"])


def _band(sizes: np.ndarray) -> np.ndarray:
    return np.clip(np.log(np.maximum(1, sizes)) / log(BAND), 0, BANDS - 1).astype(np.int64)


class _Shared:
    """Tokens that a row of x shares with the rows of a block of y. Called with a field, or one of x and one of y: with each of them; else with a few, by their places."""

    def __init__(self, x: Chunk, y: Chunk, start: int) -> None:
        self.x, self.y = x[2], y[2]
        self.ids = y[0][start : start + ROWS]
        self.ends_x = [[0, *np.cumsum(n).tolist()] for n, _, _ in self.x]
        self.starts = [np.concatenate([[0], np.cumsum(n)])[start : start + len(self.ids) + 1] for n, _, _ in self.y]
        self.sizes = [n[start : start + len(self.ids)].astype(np.int64) for n, _, _ in self.y]
        self.k, self.rows, self.spans, self.marks, self.most = 0, {}, {}, {}, {}

    def held(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block by token and band, and where each band of each token starts."""
        if g not in self.rows:
            codes = self.y[g][2][self.starts[g][0] : self.starts[g][-1]].astype(np.int64) * BANDS + np.repeat(_band(self.sizes[g]), self.sizes[g])
            rows = np.repeat(np.arange(len(self.ids)), self.sizes[g])[np.argsort(codes, kind="stable")]
            self.rows[g] = rows, np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=BANDS * len(self.y[g][1])))])
        return self.rows[g]

    def span(self, f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among y's tokens of those of row k, and where their holders start and end."""
        if (f, g) not in self.spans:
            starts, own, other = self.held(g)[1], self.x[f][1], self.y[g][1]
            place = np.minimum(np.searchsorted(other, own), max(0, len(other) - 1))
            there = other[place] == own if len(other) else np.zeros(len(own), bool)
            low, high = (np.where(there, starts[BANDS * (place + k)] if len(other) else 0, 0) for k in (0, 1))
            self.spans[f, g] = tuple(v[self.x[f][2]] for v in (place, low, high))
        a, b = self.ends_x[f][self.k], self.ends_x[f][self.k + 1]
        place, low, high = self.spans[f, g]
        return place[a:b], low[a:b], high[a:b]

    def counted(self, g: int, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        """How many of the spans each row is in; None if there is none."""
        rows = self.held(g)[0]
        lists = [rows[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True) if i < j]
        return np.bincount(np.concatenate(lists), minlength=len(self.ids)) if lists else None

    def __call__(self, f: int, g: int | None = None) -> np.ndarray:
        g = f if g is None else g
        c = self.counted(g, *self.span(f, g)[1:])
        return np.zeros(len(self.ids), np.int64) if c is None else c

    def some(self, f: int, least: int = 1) -> np.ndarray:
        """Places of the rows with ``least`` or more tokens in common."""
        c = self.counted(f, *self.span(f, f)[1:]) if self.x[f][0][self.k] >= least else None
        return np.zeros(0, np.int64) if c is None else np.flatnonzero(c >= least)

    def likely(self, f: int, least: float, also: tuple[int, int] | None = None) -> np.ndarray:
        """Places of rows that may have a Jaccard of ``least``, above 0, in field f; all that have it are among them.

        Tokens of the row that most others hold, fewer than any such pair has in common, aren't counted: what they could add is granted to all.
        also: (g, more), a field like f and what it has besides f's tokens. Those that have the Jaccard in g are found in the same search: they lack in f what both rows have more, at most.
        """
        n, m, own, others = int(self.x[f][0][self.k]), self.sizes[f], 0, 0
        if also is not None:
            g, more = also
            own, most = int(self.x[more][0][self.k]), int(self.x[g][0][self.k])
            if also not in self.most:  # what others have more is not among ``more`` where they have nothing in f
                others = np.where(m == 0, self.sizes[g], self.sizes[more])
                self.most[also] = others, int(others.max(initial=0)), int((m - self.sizes[g]).max(initial=0)), np.minimum(m, self.sizes[g])
            others, extra, over, m = self.most[also]
            low_n, slack = min(n, most), own + extra
        else:
            low_n, slack, over = n, 0, 0
        left = max(0, int(LEFT * ceil(least * low_n - slack - 1e-6)) - 1)
        if left < 1:
            return self.some(f) if also is None else together(*[self.likely(k, least) for k in (f, also[0]) if self.x[k][0][self.k]])
        place, low, high = self.span(f, f)
        starts = self.held(f)[1]
        # Rows of other bands are too short or too long.
        first, last = (min(BANDS - 1, int(log(max(1.0, v)) / log(BAND))) for v in (least * low_n - slack - 1e-6, (n + slack) / least + over + 1e-6))
        if first > 0 or last < BANDS - 1:
            place = BANDS * place[high > low]
            low, high = starts[place + first], starts[place + last + 1]
        if left < len(low):
            rare = np.argpartition(high - low, len(low) - left)[: len(low) - left]
            low, high = low[rare], high[rare]
        c = self.counted(f, low, high)
        if c is None:
            return np.zeros(0, np.int64)
        # A row of m tokens has least / (1 + least) * (n + m) in common, and least * n tokens itself.
        rows = np.flatnonzero(c >= max(1, ceil(least * low_n - slack - 1e-6) - left))
        lack = own + (others[rows] if also is not None else 0)
        return rows[c[rows] >= least / (1 + least) * (low_n + m[rows]) - lack - left - 1e-6]

    def of(self, f: int, rows: np.ndarray, g: int | None = None) -> np.ndarray:
        """The counts of some rows only."""
        g = f if g is None else g
        sizes = self.sizes[g][rows]
        ends = np.cumsum(sizes)
        place, low, high = self.span(f, g)
        place = place[low < high]
        if not len(place) or not len(rows) or not ends[-1]:
            return np.zeros(len(rows), np.int64)
        if 4 * ends[-1] > (high - low).sum() + len(self.ids):
            return self.counted(g, low, high)[rows]
        mark = self.marks.setdefault(g, np.zeros(len(self.y[g][1]), bool))
        mark[place] = True
        hits = np.concatenate([[0], np.cumsum(mark[self.y[g][2][np.repeat(self.starts[g][rows] - ends + sizes, sizes) + np.arange(ends[-1])]])])
        mark[place] = False
        return hits[ends] - hits[ends - sizes]


def together(*rows: np.ndarray) -> np.ndarray:
    """Places that one of the searches found, each once."""
    some = [r for r in rows if len(r)]
    return some[0] if len(some) == 1 else np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)


def _met(x: Chunk, y: Chunk, same: bool, decide: Decide, apart: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, value, kind) of the pairs that fit, by row of x. Rows whose flags are not ``apart`` from any of a block's aren't looked at."""
    (ids_x, flags_x, fields_x), (ids_y, flags_y, _) = x, y
    for start in range(0, len(ids_y), ROWS):
        shared = _Shared(x, y, start)
        ids, flags, sizes = shared.ids, flags_y[start : start + ROWS], shared.sizes
        rows = np.arange(len(ids_x))
        if apart is not None:
            low, high = flags.min(), flags.max()
            rows = rows[(np.maximum(high - flags_x, flags_x - low) >= apart[0]) & (np.maximum(low - flags_x, flags_x - high) <= apart[1])]
        for k in rows.tolist():
            shared.k, later = k, ids > ids_x[k]
            fit, value, *kind = decide(shared, lambda f, k=k: int(fields_x[f][0][k]), lambda f, sizes=sizes: sizes[f], int(flags_x[k]), flags, later)
            hit, at = (np.flatnonzero(fit),) * 2 if fit.dtype == bool else (fit, np.arange(len(fit)))
            if same:
                hit, at = hit[later[hit]], at[later[hit]]
            if len(hit):
                yield np.minimum(ids[hit], ids_x[k]), np.maximum(ids[hit], ids_x[k]), value[at], kind[0][at] if kind else np.zeros(len(hit), np.int32)


def _dealt(rows: DataFrame, groups: int, reach: int | None) -> Column:
    """The group of a row: by its id, or where only near flags meet, by its place in the order of flags."""
    if reach is None or groups == 1:
        return F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    place = F.col("flags") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    cuts = rows.agg(F.percentile_approx(place, [k / groups for k in range(1, groups)], 10_000).alias("x")).first()["x"] or []
    return sum((F.when(place > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def pairs_of_sets(rows: DataFrame, fields: Sequence[str], decide: Decide, reach: int | None = None, least: int = 0) -> DataFrame:
    """(a, b, value, kind), a < b: pairs of ``rows`` (id, flags, fields …) that ``decide`` finds fit, each once. Ids and tokens, arrays without repeats, are longs; null arrays are empty.

    reach: how far the flags of a pair that fits are apart at most; rows farther apart don't meet. least: how far at least, where reach is given; chunks all of whose rows are nearer don't meet.
    """
    held = rows.select("id", F.col("flags").cast("long").alias("flags"), *[F.coalesce(f, F.array().cast("array<bigint>")).alias(f) for f in fields])
    total = held.agg(F.sum(sum((F.size(f) for f in fields), F.lit(0)))).first()[0] or 0
    groups = 1 if total <= ALONE else max(GROUPS if reach is None else 2 * GROUPS, ceil(total / TOKENS))
    pieces = held.select("id", "flags", _dealt(held, groups, reach).alias("g"), *fields).mapInArrow(_packed, "g int, piece binary")
    chunks = checkpointed(pieces.repartitionById(groups, F.col("g")).mapInArrow(_merged, "name long, low long, high long, chunk binary"))
    x, y = (chunks.select(*[F.col(c).alias(f"{c}_{k}") for c in chunks.columns]) for k in "xy")
    near = F.col("name_x") <= F.col("name_y")
    if reach is not None:
        near = near & (F.col("low_x") - F.col("high_y") <= reach) & (F.col("low_y") - F.col("high_x") <= reach)
        near = near & (F.greatest(F.col("high_x") - F.col("low_y"), F.col("high_y") - F.col("low_x")) >= least)
    apart = None if reach is None else (least, reach)
    met = x.join(y.hint("shuffle_replicate_nl"), near).select((F.col("name_x") == F.col("name_y")).alias("own"), "chunk_x", "chunk_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, left, right in zip(*batch.columns, strict=True):
                a = _read(left.as_py())
                out, size = [], 0
                for found in _met(a, a if own.as_py() else _read(right.as_py()), own.as_py(), decide, apart):
                    out.append(found)
                    size += len(found[0])
                    if size > ROWS:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return met.mapInArrow(run, "a long, b long, value double, kind int")


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, value, kind = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64()), pa.array(kind.astype(np.int32), pa.int32())], names=["a", "b", "value", "kind"])
