"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in three bits or fewer differ in two or fewer once the block of 16 bits that holds most of the
differences is set aside. So every fingerprint, with each of its four blocks set aside, emits all variants of the other 48 bits within
distance one, half the radius of two; fingerprints that link meet at a variant. Variants are 48 bits wide, so that chance meetings stay
rare for billions of fingerprints, and each fingerprint emits 4 * 49 rows however many there are.

At a variant, fingerprints with the same set-aside block differ in two bits at most, so all link: a star to the least. Stars whose blocks
differ in one bit link as well (1 + 2 bits). Fingerprints that equal the variant link if their blocks differ in three bits or fewer. Any
pair of three bits or fewer is met in one of these three ways, and none of them walks over the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, components, put_back, set_apart, shuffle_partitions

BLOCKS, WIDE, KEPT = 4, 16, 48
LOW = (1 << KEPT) - 1
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; a text without words has zero."""
    from xxhash import xxh64_digest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    bits = np.frombuffer(b"".join([xxh64_digest(g, 42) for g in grams]), np.uint8).reshape(n, 8)
    over = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        over += np.unpackbits(bits[i : i + CHUNK], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each block set aside, the variants of the other 48 bits within distance one. The key's top bits name the block."""
    flips = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range(KEPT))]])
    fp, parts = F.col("fp"), []
    for p in range(BLOCKS):
        turned = fp if not p else F.shiftleft(fp, WIDE * p).bitwiseOR(F.shiftrightunsigned(fp, 64 - WIDE * p))
        base = turned.bitwiseAND(F.lit(LOW)).bitwiseOR(F.lit(p << KEPT))
        parts.append(F.transform(flips, base.bitwiseXOR))
    return fps.select(F.explode(F.concat(*parts)).alias("key"), "fp")


def _turned(fp: np.ndarray, p: int) -> np.ndarray:
    return fp if not p else (fp << np.uint64(WIDE * p)) | (fp >> np.uint64(64 - WIDE * p))


def _triples() -> np.ndarray:
    return np.array([(1 << a) | (1 << b) | (1 << c) for a, b, c in combinations(range(WIDE), 3)], np.uint64)


def bucket_links(key: int, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links at one variant that join all that link there; at most a few for each fingerprint."""
    turned = _turned(fp, key >> KEPT)
    order = np.lexsort((fp, turned >> np.uint64(KEPT)))
    fp, turned = fp[order], turned[order]
    block, at = np.unique(turned >> np.uint64(KEPT), return_index=True)
    head = np.repeat(fp[at], np.diff(np.append(at, len(fp))))
    out = [(head[head != fp], fp[head != fp])]

    def near(values: np.ndarray, own: np.ndarray, masks: np.ndarray) -> None:
        for m in masks:
            to = values ^ m
            i = np.minimum(np.searchsorted(values, to), len(values) - 1)
            hit = (values[i] == to) & (values < to)
            if hit.any():
                out.append((own[hit], own[i[hit]]))

    if len(block) > 1:
        near(block, fp[at], np.uint64(1) << np.arange(WIDE, dtype=np.uint64))
        exact = (turned & np.uint64(LOW)) == np.uint64(key & LOW)
        if exact.sum() > 1:
            values, own = turned[exact] >> np.uint64(KEPT), fp[exact]
            if len(values) <= 64:
                i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, 1))
                out.append((own[i], own[j]))
            else:
                near(values, own, _triples())
    return out


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; a key's fingerprints may go over a batch's end."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def met(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        same = key[1:] == key[:-1]
        some = np.append(same, False) | np.append(False, same)
        key, fp = key[some], fp[some]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(at, len(key)))
        two = at[size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= 3
        found = [(a[near], b[near])]
        for i, n in zip(at[size > 2], size[size > 2], strict=True):
            found += bucket_links(int(key[i]), fp[i : i + n])
        ends = np.concatenate([np.stack(x) for x in found], axis=1)
        ends = np.unique(np.stack([ends.min(0), ends.max(0)]), axis=1).view(np.int64)
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    for batch in batches:
        key, fp = np.append(key, batch["key"].to_numpy()), np.append(fp, batch["fp"].to_numpy().view(np.uint64))
        if not len(key):
            continue
        cut = np.searchsorted(key, key[-1])  # the last key's rows wait for the next batch
        if cut:
            yield met(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key) > 1:
        yield met(key, fp)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all of three differing bits or fewer; each is such a pair."""
    # Dealt by count first: fingerprints are few bytes, which few tasks would otherwise turn into 196 rows each.
    dealt = variants(fps.repartition(shuffle_partitions(fps.sparkSession))).repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row: documents whose fingerprints differ in 3 bits or fewer link.

    ``component_id`` is the smallest id that can be reached. Null and blank texts have fingerprint zero and link like any other. A null id
    is never a component's id unless all its rows have null ids. Repeated rows come out as often as they came in. Long texts are read whole. Other
    columns, whatever their names, are left out. No rows: no rows.
    """
    own = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    least = own.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(least.select("fp")))
    named = least.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(group, "root").select("fp", "component_id")
    return own.join(of, "fp").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, with all its columns, whatever their names.

    Rows that repeat an id count as one document, of which one row stays. Rows with a null id can't be named and all stay. No rows: no rows.
    """
    own, i, t = set_apart(docs, id_col, text_col)
    found = near_duplicates(own, i, t)
    kept = found.where(F.col(i) == F.col("component_id")).select(F.col(i).alias("kept")).distinct()
    first = Window.partitionBy(i).orderBy(F.col(t).asc_nulls_last())
    out = own.join(kept, F.col(i) == F.col("kept"), "left").where(F.col("kept").isNotNull() | F.col(i).isNull())
    return put_back(out.withColumn("n", F.row_number().over(first)).where((F.col("n") == 1) | F.col(i).isNull()), docs)
