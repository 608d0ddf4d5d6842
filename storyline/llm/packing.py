"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: what a layer does for each token, and attention within the document. Pieces are
assigned in descending length, each to the sequence of the lowest cost with room for it; a piece that no sequence has room for is cut.

Documents are packed in shards of about ``SHARD`` tokens, each by one task as it reads its input, without a shuffle. A shard's sequences hold its
tokens exactly: full ones of 2048, and the rest in powers of two, which need no padding. Ids of sequences are unique: the task's partition and
a count. They depend on how the input is dealt into partitions, not on when or where a task runs.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_dicts, arrow_rows

LENGTH, END, SHARD = 2048, 1, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the vocabulary's special token and its id. As by default, the string in a text is the token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: White space after which a text goes to ``tokenizers``: the other form matches such a run by recursion, and a million blanks end it.
LONG_RUN = re.compile(r"(?:^|\S)\s{10000}")


class Tokens:
    """Text to the bytes of its ids, little-endian unsigned 32-bit; the ids that ``tokenizers`` gives with the same vocabulary's json file.

    The vocabulary's ``tiktoken`` form gives the same ids in a ninth of the time. Texts with a very long run of white space, which it can't
    take, go to ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        self.vocabulary, self.whole = vocabulary, None
        self.encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of(self, text: str) -> bytes:
        if SPECIAL in text:
            return array("I", [SPECIAL_ID]).tobytes().join([self.of(x) for x in text.split(SPECIAL)])
        return array("I", self.slow(text) if LONG_RUN.search(text) else self.encode(text)).tobytes()

    def slow(self, text: str) -> list[int]:
        if self.whole is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))
        return self.whole.encode(text, add_special_tokens=False).ids


def cost(n: np.ndarray | float) -> np.ndarray | float:
    return LINEAR * n + QUADRATIC * n * n


def packed(lengths: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces; sequences count from 0."""
    n_full = 0
    for i, n in enumerate(lengths):
        for start in range(0, n - length + 1, length):
            yield i, start, length, n_full, 0
            n_full += 1
    rest = sorted(((n % length, i) for i, n in enumerate(lengths) if n % length), key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _ in rest)
    room = np.array([length] * (total // length) + [1 << b for b in reversed(range(length.bit_length())) if total % length >> b & 1], np.int64)
    free, spent = room.copy(), np.zeros(len(room))
    for n, i in rest:
        start = lengths[i] - n
        while n:
            fits = free >= n
            k = int(np.argmin(np.where(fits if fits.any() else free > 0, spent, np.inf)))
            take = min(n, int(free[k]))
            yield i, start, take, n_full + k, int(room[k] - free[k])
            free[k] -= take
            spent[k] += cost(take)
            n, start = n - take, start + take


def _task(vocabulary: str, length: int, shard: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        tokens, end = Tokens(vocabulary), np.array([END], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 32

        def settled(held: list[tuple], first: int) -> Iterator[tuple]:
            for i, start, n, k, offset in packed([len(ids) // 4 for _, ids in held], length):
                doc, ids = held[i]
                yield doc, start, n, crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + first + k, offset

        def rows() -> Iterator[tuple]:
            held, size, first = [], 0, 0
            for x in arrow_dicts(batches):
                held.append((x["doc_id"], tokens.of(x["text"] or "") + end))
                size += len(held[-1][1]) // 4
                if size >= shard:
                    yield from settled(held, first)
                    held, size, first = [], 0, first + 2 * size // length + 64
            yield from settled(held, first)

        yield from arrow_rows(rows(), PIECES)

    return pack


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids end with END; a null or empty text has that alone. Each id lies in one piece; pieces fill their sequence from 0
    without gaps. Repeated rows and ids are packed like any others. A very long text is tokenized whole, in some 40 bytes of memory for each of its
    characters, and cut into full sequences. Other columns, whatever their names, are left out. ``length`` is a power of two. No rows: no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_task(vocabulary, length, shard), PIECES)
