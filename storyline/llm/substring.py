"""Exact repeats of long word sequences by fixed-block anchors.

Any window of ``window`` words holds a whole block of ``window // 2`` words that starts at a multiple of that length in its document. So

1. every document indexes its non-overlapping blocks and probes the index with every rolling window of a block's length;
2. a probe that meets a block of a document with a smaller id is an anchor, in the probing document and in the block's;
3. anchors are extended: all windows around them are compared by 96 bits of their words, and those whose words also start in a document
   with a smaller id are repeats; the union of a document's overlapping repeats is its maximal exact repeats.

Only the smallest id of each block and window counts, so the work stays linear however many copies there are. Hashes go to the shuffle as
packed arrays, a row for each batch of documents and partition of the hash space. Of what a batch holds more than once, one copy goes out and
the rest is settled in the batch, so that a passage that a third of all documents share adds a few bytes for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_dicts, arrow_rows, shuffle_partitions

WINDOW = 50
#: Words handled at a time at least, and most; distinct words whose hashes are remembered.
BATCH_WORDS, MOST_WORDS, CACHE = 1 << 20, 1 << 24, 300_000
#: Bytes of texts for which there is a part of the hash space; what a task holds grows with it. Words of a batch for each part.
PART_BYTES, PART_WORDS = 64 << 20, 64
#: Odd multipliers of the two rolling hashes.
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INDEX, PROBE, KNOWN = 0, 1, 2
PACKED = "part int, kind int, id binary, tag binary, n binary, pos binary, h binary, g binary"
SENT = "dest int, id binary, tag binary, n binary, pos binary"
FOUND = "id long, tag long, pos binary"


class _Hashes(dict):
    """Word to the 8 bytes of its hash; forgets all when full."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh64_digest

        if len(self) > CACHE:
            self.clear()
        self[word] = out = xxh64_digest(word, 7)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


class _Rolling:
    """Polynomial hashes, modulo 2**64, of all runs of ``k`` words."""

    def __init__(self, m: int):
        self.m, self.inv, self.up, self.down = m, pow(m, -1, 1 << 64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h)
        if len(self.up) < n:
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, self.m, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, self.inv, np.uint64)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(h * self.down[:n], dtype=np.uint64))
        out = (sums[k:] - sums[:-k]) * self.up[: n - k + 1]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(29))


class _Batch:
    """Some documents' word hashes end to end."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.tags: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self.size = 0

    def add(self, id_: int, tag: int, h: np.ndarray, hits: np.ndarray | None = None) -> None:
        self.ids.append(id_)
        self.tags.append(tag)
        self.hashes.append(h)
        self.size += len(h)
        if hits is not None:
            self.hits.append(hits)

    def laid_out(self) -> tuple[np.ndarray, ...]:
        n = np.array([len(h) for h in self.hashes], np.int64)
        start = np.cumsum(n) - n
        return np.concatenate(self.hashes), n, start, np.array(self.ids, np.int64), np.array(self.tags, np.int64)


def _small(x: np.ndarray) -> bytes:
    """As 2-byte numbers, or as 4-byte numbers if one needs it; which of them shows in the length."""
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype(np.int64)


def batch_words(parts: int) -> int:
    """Words of a batch: more where there are more parts, so that packed rows don't become too short."""
    return min(MOST_WORDS, max(BATCH_WORDS, PART_WORDS * parts))


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)


def _rows(kind: int, parts: int, at: np.ndarray, h: np.ndarray, wide: np.ndarray | None, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> list[tuple]:
    """Packed rows of the entries at words ``at`` with hashes ``h``; 96 bits of each go along with ``wide``, 64 for blocks, 32 for probes."""
    if not len(at):
        return []
    part = _parts(h, parts)
    order = np.argsort(part, kind="stable")
    part, at, h, doc = part[order], at[order], h[order], doc[order]
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    out = []
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        d = doc[i:j]
        first = np.append(0, np.flatnonzero(d[1:] != d[:-1]) + 1)
        own = d[first]
        out.append((
            int(part[i]), kind, ids[own].astype("<i8").tobytes(), tags[own].astype("<u4").tobytes(), _small(np.diff(np.append(first, j - i))), _small(at[i:j] - start[d]),
            (h[i:j] if wide is not None or kind == INDEX else h[i:j].astype("<u4")).tobytes() if kind != KNOWN else b"", wide[order[i:j]].astype("<u4").tobytes() if wide is not None and kind != KNOWN else b"",
        ))
    return out


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    ids, tags = np.frombuffer(row["id"], "<i8"), np.frombuffer(row["tag"], "<u4").astype(np.int64)
    n = _wide(row["n"], len(ids))
    return np.repeat(ids, n), np.repeat(tags, n), _wide(row["pos"], int(n.sum()))


def _sent(chunks: Iterator[tuple], parts: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Found words (ids, tags, positions) as packed rows, one for each part of the ids and ``most`` words."""

    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0

        def packed() -> Iterator[tuple]:
            ids, tags, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            dest = _parts(ids.astype(np.uint64) * np.uint64(M1), parts)
            order = np.lexsort((tags, ids, dest))
            ids, tags, pos, dest = ids[order], tags[order], pos[order], dest[order]
            edge = np.append(np.flatnonzero(np.append(True, dest[1:] != dest[:-1])), len(dest))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                d, t = ids[i:j], tags[i:j]
                first = np.append(0, np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1)
                n = np.diff(np.append(first, j - i))
                yield int(dest[i]), d[first].astype("<i8").tobytes(), t[first].astype("<u4").tobytes(), _small(n), _small(pos[i:j])

        for chunk in chunks:
            if len(chunk[0]):
                held.append(chunk)
                size += len(chunk[0])
                if size >= most:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    yield from arrow_rows(rows(), SENT, 64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with all its positions. Rows come sorted by part; the positions of one part are held."""

    def rows() -> Iterator[tuple]:
        dest, held = None, []

        def split() -> Iterator[tuple]:
            if held:
                ids, tags, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((pos, tags, ids))
                ids, tags, raw = ids[order], tags[order], pos[order].astype("<u4").tobytes()
                edge = np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))), len(ids)).tolist()
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    yield int(ids[i]), int(tags[i]), raw[4 * i : 4 * j]

        for row in arrow_dicts(batches):
            if row["dest"] != dest:
                yield from split()
                dest, held = row["dest"], []
            ids, tags, pos = _unpacked(row)
            held.append((ids, tags, pos.astype(np.uint32)))
        yield from split()

    yield from arrow_rows(rows(), FOUND)


def _packer() -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3)

        def rows() -> Iterator[tuple]:
            for x in arrow_dicts(batches):
                text = (x["text"] or "").encode("utf-8", "surrogatepass")
                yield x["id"], crc32(text), press.compress(text)

        yield from arrow_rows(rows(), "id long, tag long, z binary", 256)

    return pack


def _anchored(parts: int, block: int, window: int) -> Callable:
    """From texts to packed index blocks and probes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        hashes, rolling, most = _Hashes(), _Rolling(M1), batch_words(parts)

        def settled(b: _Batch) -> Iterator[tuple]:
            h, n, start, ids, tags = b.laid_out()
            doc = np.repeat(np.arange(len(n)), n)
            local = np.arange(len(h)) - start[doc]
            at = np.flatnonzero(local + block <= n[doc])
            roll = rolling(h, block)[at]
            order = np.argsort(roll, kind="stable")
            s, who = roll[order], ids[doc[at[order]]]
            new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(new, len(s)))
            low, high = np.minimum.reduceat(who, new), np.maximum.reduceat(who, new)
            several = np.repeat(low < high, size)
            shared = np.zeros(len(at), bool)
            shared[order] = several
            # Of what several documents of the batch hold, the last document's first probe goes out, the blocks of the smallest that has any, and all are anchors.
            out = ~shared
            last = order[several & (who == np.repeat(high, size))]
            if len(last):
                out[last[np.unique(roll[last], return_index=True)[1]]] = True
            aligned = local[at] % block == 0
            least = np.minimum.reduceat(np.where(aligned[order], who, np.iinfo(np.int64).max), new)
            blocks = np.zeros(len(at), bool)
            blocks[order] = who == np.repeat(least, size)
            blocks &= aligned
            for kind, some in ((INDEX, blocks), (PROBE, out), (KNOWN, shared)):
                yield from _rows(kind, parts, at[some], roll[some], None, doc[at[some]], start, ids, tags)

        def rows() -> Iterator[tuple]:
            b = _Batch()
            for x in arrow_dicts(batches):
                text = (x["text"] or "").encode("utf-8", "surrogatepass")
                if x["id"] is None or len(w := text.split()) < window:
                    continue
                b.add(x["id"], crc32(text), hashes.of(w))
                if b.size >= most:
                    yield from settled(b)
                    b = _Batch()
            if b.size:
                yield from settled(b)

        yield from arrow_rows(rows(), PACKED, 64)

    return emit


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Anchors. Rows come sorted by part and kind: the blocks of a part, then its probes, then anchors that are known."""

    def rows() -> Iterator[tuple]:
        part, index, blocks = None, [], None

        def built() -> tuple[np.ndarray, ...]:
            h, ids, tags, pos = (np.concatenate(x) for x in zip(*index, strict=True)) if index else (np.zeros(0, t) for t in ("<u8", "<i8", "<i8", "<i8"))
            short = h.astype("<u4")
            order = np.lexsort((ids, h, short))
            h, ids, tags, pos, short = h[order], ids[order], tags[order], pos[order], short[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
            mine = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(h))))
            keep = ids == ids[new][mine] if len(h) else np.zeros(0, bool)
            return short[new], ids[new], np.zeros(len(new), bool), ids[keep], tags[keep], pos[keep], mine[keep]

        def met() -> Iterator[tuple]:
            if blocks is not None:
                _, _, used, ids, tags, pos, mine = blocks
                some = used[mine]
                yield ids[some], tags[some], pos[some]

        for row in arrow_dicts(batches):
            if row["part"] != part:
                yield from met()
                part, index, blocks = row["part"], [], None
            ids, tags, pos = _unpacked(row)
            if row["kind"] == INDEX:
                index.append((np.frombuffer(row["h"], "<u8"), ids, tags, pos))
                continue
            if row["kind"] == PROBE:
                if blocks is None:
                    blocks, index = built(), []
                if not len(blocks[0]):
                    continue
                h = np.frombuffer(row["h"], "<u4")
                i, end = np.searchsorted(blocks[0], h), np.searchsorted(blocks[0], h, "right")
                hit = np.zeros(len(h), bool)
                while (more := i < end).any():  # blocks that differ seldom have the same 32 bits; then a probe meets each
                    more[more] = blocks[1][i[more]] < ids[more]
                    blocks[2][i[more]] = True
                    hit |= more
                    i = i + 1
                ids, tags, pos = ids[hit], tags[hit], pos[hit]
            yield ids, tags, pos
        yield from met()

    return rows()


def _opened(x: dict) -> list[bytes]:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(x["z"]).split()


def _extended(parts: int, block: int, window: int) -> Callable:
    """From documents with their anchors to the packed windows around these."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, one, two, most = _Hashes(), _Rolling(M1), _Rolling(M2), batch_words(parts)

        def settled(b: _Batch) -> Iterator[tuple]:
            h, n, start, ids, tags = b.laid_out()
            doc = np.repeat(np.arange(len(n)), n)
            step = np.zeros(len(h) + 1, np.int64)
            for hits, s, m in zip(b.hits, start, n, strict=True):
                np.add.at(step, s + np.maximum(0, hits - (window - block)), 1)
                np.add.at(step, s + np.minimum(hits, m - window) + 1, -1)
            at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            if not len(at):
                return
            a, c = one(h, window)[at], two(h, window)[at]
            who = ids[doc[at]]
            order = np.lexsort((who, c, a))
            x, y = a[order], c[order]
            new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            least = np.repeat(who[order][new], np.diff(np.append(new, len(x))))
            repeat = np.zeros(len(at), bool)
            repeat[order] = who[order] > least
            yield from _rows(PROBE, parts, at[~repeat], a[~repeat], c[~repeat], doc[at[~repeat]], start, ids, tags)
            yield from _rows(KNOWN, parts, at[repeat], a[repeat], None, doc[at[repeat]], start, ids, tags)

        def rows() -> Iterator[tuple]:
            b = _Batch()
            for x in arrow_dicts(batches):
                if not x["pos"]:
                    continue
                b.add(x["id"], x["tag"], hashes.of(_opened(x)), np.unique(np.frombuffer(x["pos"], "<u4")).astype(np.int64))
                if b.size >= most:
                    yield from settled(b)
                    b = _Batch()
            if b.size:
                yield from settled(b)

        yield from arrow_rows(rows(), PACKED, 64)

    return emit


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Windows whose words a smaller id also has. Of a part, the windows met once in each batch are held, 28 bytes each."""

    def rows() -> Iterator[tuple]:
        part, held = None, []

        def judged() -> Iterator[tuple]:
            if held:
                a, c, ids, tags, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((ids, c, a))
                x, y, who = a[order], c[order], ids[order]
                new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                repeat = np.zeros(len(a), bool)
                repeat[order] = who > np.repeat(who[new], np.diff(np.append(new, len(a))))
                yield ids[repeat], tags[repeat].astype(np.int64), pos[repeat].astype(np.int64)

        for row in arrow_dicts(batches):
            if row["part"] != part:
                yield from judged()
                part, held = row["part"], []
            ids, tags, pos = _unpacked(row)
            if row["kind"] == KNOWN:
                yield ids, tags, pos
            else:
                held.append((np.frombuffer(row["h"], "<u8"), np.frombuffer(row["g"], "<u4"), ids, tags.astype(np.uint32), pos.astype(np.uint32)))
        yield from judged()

    return rows()


def _removed(window: int) -> Callable:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for x in arrow_dicts(batches):
                w = _opened(x)
                n = len(w)
                if x["pos"]:
                    step = np.zeros(n + 1, np.int64)
                    at = np.unique(np.frombuffer(x["pos"], "<u4")).astype(np.int64)
                    step[at] += 1
                    step[at + window] -= 1
                    w = [w[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                yield x["id"], n, n - len(w), b" ".join(w).decode("utf-8", "surrogatepass")

        yield from arrow_rows(rows(), "id long, n_words long, n_removed long, kept string", 1000)

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): each row's text without the words of repeated windows, its other words joined by blanks.

    Words are runs without ASCII white space, unchanged. A window is ``window`` words; it is a repeat if its words also start in a row with a
    smaller id. Windows are judged on the input. Null and blank texts have no words. Rows with a null id are never removed from and never make
    others repeats; rows of equal ids never do so to each other. A very long text is one batch of its own, some 60 bytes for each of its words. Other
    columns, whatever their names, are left out. No rows: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block, parts = window // 2, max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))
    # Texts are dealt by id once, compressed; extending and removing both read that exchange.
    whole = texts.mapInArrow(_packer(), "id long, tag long, z binary")

    def grouped(packed: DataFrame, by: Callable) -> DataFrame:
        found = packed.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(lambda b: _sent(by(b), parts), SENT)
        return found.repartition(parts, "dest").sortWithinPartitions("dest").mapInArrow(_gathered, FOUND)

    anchors = grouped(texts.mapInArrow(_anchored(parts, block, window), PACKED), _matched)
    # Left and by merging, as below, so that the exchange of the texts is the same.
    windows = whole.join(anchors.hint("merge"), ["id", "tag"], "left").mapInArrow(_extended(parts, block, window), PACKED)
    out = whole.join(grouped(windows, _flagged).hint("merge"), ["id", "tag"], "left").mapInArrow(_removed(window), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
