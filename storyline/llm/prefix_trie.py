"""Prefix tries of conversations: shared beginnings as nodes, found by count-min screening of prefix digests.

A turn becomes a digest of role and text before anything is shuffled, so texts never are. Turns are put in order by a range partitioning that also
splits a conversation of very many turns, and numbered. A prefix's digest is the sum of hashes of (place, turn): sums run in blocks of turns, so no
task holds a whole conversation. All prefixes are counted in a count-min sketch, whose size has a bound. Its estimate is never too low; so an estimate of one
proves a prefix, and all longer ones, to belong to one conversation alone. Such tails become nodes where they are; only prefixes that may be
shared are shuffled and grouped exactly.

Sums over subtrees need no ancestors: each node belongs to its smallest member, which so owns the end of its own path. What a member owns below a node
is what it adds to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_dicts, arrow_rows, checkpointed, shared_dir, shuffle_partitions, words

#: Turns of a conversation that are summed in one task.
BLOCK = 4096
#: The sketch: rows, and counters for each prefix, in all of them between LEAST and MOST. A counter is a byte, which stops at TOP.
ROWS, EACH, LEAST, MOST, TOP = 4, 8, 1 << 16, 1 << 26, 255
#: Counters that travel together when sketches are added up; ids of conversations that are hashed at a time.
SLAB, CHUNK = 1 << 16, 1 << 16
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
PIECES = ["s0", "s1", "s2", "s3"]


class Borrow(NamedTuple):
    """A conversation begins with the first ``most`` turns at most of another one: how many, and whose."""

    of: Callable[[Column], Column]
    turns: Callable[[Column], Column]
    most: int


#: As given: the first CRC-32 mod 4 turns of the conversation whose id is the next multiple of 20 below.
GIVEN = Borrow(lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3)


def turn_digest(role: Column, text: Column) -> Column:
    """A turn's 128 bits; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, digest, words) with ``place`` from 1: by turn, null first, equal ones by digest."""
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("salt")]
    # The salt splits rows that are equal in all, which then may come in any order.
    dealt = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    held = checkpointed(dealt.select("conv_id", "digest", "words", F.spark_partition_id().alias("part")))
    # Where a partition begins within a conversation: at most one row for each partition.
    spans = held.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    ends = spans.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("n", "conv_id").alias("n")).collect()
    before, offsets, carried = None, {}, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        if r["first"] != before:
            carried = 0
        offsets[r["part"]] = carried
        carried = (carried if r["last"] == r["first"] else 0) + r["n"]
        before = r["last"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            each = np.arange(len(ids))
            new = np.concatenate([[True], ids[1:] != ids[:-1]])
            place = each - np.maximum.accumulate(np.where(new, each, 0)) + 1
            # The batch's first conversation may have begun in the batch, or the partition, before.
            place[ids == ids[0]] += offsets[batch.column(3)[0].as_py()] if at is None else n if at == ids[0] else 0
            at, n = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place, pa.int64())], names=["conv_id", "digest", "words", "place"])

    return held.mapInArrow(count, "conv_id long, digest binary, words long, place long")


def running(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` summed up to each row in the order of ``at``, within ``key``: in blocks of BLOCK places, then over the blocks' sums."""
    blocked = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(key, "_block", *[F.sum(f"_{v}").over(earlier).alias(f"_{v}") for v in values]).where("_block > 0")
    summed = blocked.select(*[c for c in blocked.columns if c not in values], *[F.sum(v).over(inside).alias(v) for v in values]).join(sums, [key, "_block"], "left")
    kept = [c for c in rows.columns if c not in values]
    return summed.select(*kept, *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])


def rebuilt(turns: DataFrame, borrow: Borrow = GIVEN) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; their turns: conv_id, length, place, digest, words), each beginning with turns borrowed from another."""
    placed = checkpointed(numbered(turns))
    first = placed.where(F.col("place") <= borrow.most).select(F.col("conv_id").alias("lender"), "place", "digest", "words")
    own = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    wish = own.select("conv_id", "own", borrow.of(F.col("conv_id")).alias("lender"), borrow.turns(F.col("conv_id")).cast("long").alias("wish"))
    lent = checkpointed(wish.where("wish > 0").join(first, "lender").where("place <= wish").select("conv_id", "place", "digest", "words"))
    have = wish.join(lent.groupBy("conv_id").agg(F.count("*").alias("lent")), "conv_id", "left").withColumn("lent", F.coalesce("lent", F.lit(0)))
    convs = checkpointed(have.select("conv_id", "own", "wish", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("wish"))).alias("length")))
    # A row for each block of a conversation's turns, so that a very long one is joined in many tasks.
    blocks = convs.select("conv_id", "wish", "lent", "length", F.explode(F.sequence(F.lit(0), F.floor(F.col("own") / BLOCK))).alias("block"))
    rest = placed.withColumn("block", F.floor(F.col("place") / BLOCK)).join(blocks, ["conv_id", "block"]).where("place > wish")
    kept = rest.select("conv_id", "length", (F.col("place") - F.col("wish") + F.col("lent")).alias("place"), "digest", "words")
    return convs.select("conv_id", "length"), lent.join(convs.select("conv_id", "length"), "conv_id").select(kept.columns).unionByName(kept)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, length, depth, p, q, up_p, up_q, words) of each turn: p and q name the prefix that ends with it, up_p and up_q the one before."""
    x, y = F.xxhash64("place", "digest"), F.xxhash64("digest", "place")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    own = turns.select("conv_id", "length", F.col("place").alias("depth"), "words", x.alias("x"), y.alias("y"))
    halves = own.select("conv_id", "length", "depth", "words", *[f(c).alias(f"h{k}") for k, (c, f) in enumerate([(F.col("x"), low), (F.shiftrightunsigned("x", 32), lambda h: h), (F.col("y"), low), (F.shiftrightunsigned("y", 32), lambda h: h)])])
    # Sums of 32 bits each, which 2 ** 31 turns don't overflow.
    summed = running(halves.select("*", *[F.col(f"h{k}").alias(s) for k, s in enumerate(PIECES)]), "conv_id", "depth", PIECES)
    before = [F.col(s) - F.col(f"h{k}") for k, s in enumerate(PIECES)]
    up = F.col("depth") - 1
    return summed.select(
        "conv_id", "length", "depth", F.xxhash64("depth", "s0", "s1").alias("p"), F.xxhash64("depth", "s2", "s3").alias("q"),
        F.xxhash64(up, before[0], before[1]).alias("up_p"), F.xxhash64(up, before[2], before[3]).alias("up_q"), "words",
    )


def _cells(p: np.ndarray, q: np.ndarray, width: int) -> list[np.ndarray]:
    """Each prefix's counter in each row of the sketch."""
    p, q = p.astype(np.uint64), q.astype(np.uint64) | np.uint64(1)
    return [(((p + np.uint64(k) * q) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % width + k * width for k in range(ROWS)]


def sketch(rows: DataFrame, n: int) -> np.ndarray:
    """A count-min sketch of all prefixes (p, q), as bytes that stop at TOP. n: how many there are, which sets its size.

    Each task counts its own; slabs of counters are added up by place. What comes to the driver, and to each executor, is MOST bytes at most.
    """
    width = max(LEAST, min(MOST, 1 << max(0, n * EACH - 1).bit_length())) // ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for cells in _cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width):
                at, m = np.unique(cells, return_counts=True)
                slabs, starts = np.unique(at // SLAB, return_index=True)
                for slab, here, more in zip(slabs.tolist(), np.split(at % SLAB, starts[1:]), np.split(m, starts[1:]), strict=True):
                    own = held.setdefault(slab, np.zeros(SLAB, np.uint8))
                    own[here] = np.minimum(own[here] + more, TOP)
        yield from arrow_rows(((slab, _packed(own)) for slab, own in held.items()), "slab int, counters binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slab."""

        def rows_() -> Iterator[tuple]:
            at, total = None, None
            for r in arrow_dicts(batches, 64):
                own = _unpacked(r["counters"])
                if at == r["slab"]:
                    total = np.minimum(total + own, TOP)
                    continue
                if at is not None:
                    yield at, _packed(total.astype(np.uint8))
                at, total = r["slab"], own
            if at is not None:
                yield at, _packed(total.astype(np.uint8))

        yield from arrow_rows(rows_(), "slab int, counters binary")

    added = rows.select("p", "q").mapInArrow(count, "slab int, counters binary").repartition("slab").sortWithinPartitions("slab").mapInArrow(add, "slab int, counters binary")
    out = np.zeros(width * ROWS + SLAB, np.uint8)
    for r in added.collect():
        out[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = _unpacked(bytes(r["counters"]))
    return out[: width * ROWS]


def _packed(counters: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(counters.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(data), np.uint8).astype(np.int64)


def screened(rows: DataFrame, counters: np.ndarray) -> DataFrame:
    """``rows`` with ``alone``: the sketch proves that no other conversation has the prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(counters)  # MOST bytes at most
    schema = T.StructType([*rows.schema.fields, T.StructField("alone", T.BooleanType())])
    p, q = rows.columns.index("p"), rows.columns.index("q")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            least = np.minimum.reduce([c[cells] for cells in _cells(batch.column(p).to_numpy(), batch.column(q).to_numpy(), len(c) // ROWS)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least <= 1)], names=[*batch.schema.names, "alone"])

    return rows.mapInArrow(look, schema)


def _ends(ends: DataFrame) -> DataFrame:
    """(p, q, ends_sha256): SHA-256 of the ids of the conversations that end at a node. ends: (p, q, conv_id).

    Ids are sorted and written out in many tasks, some thousands to a chunk; what takes a node's chunks in order is the hash alone, which holds one of them at a time.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, held = None, []
            for r in arrow_dicts(batches, 4096):
                if held and (at != (r["p"], r["q"]) or len(held) >= CHUNK):
                    yield *at, held[0], ",".join(map(str, held)).encode()
                    held = []
                at = (r["p"], r["q"])
                held.append(r["conv_id"])
            if held:
                yield *at, held[0], ",".join(map(str, held)).encode()

        yield from arrow_rows(rows(), "p long, q long, first long, ids binary")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def rows() -> Iterator[tuple]:
            at, h = None, None
            for r in arrow_dicts(batches, 64):
                if at != (r["p"], r["q"]):
                    if at:
                        yield *at, h.hexdigest()
                    at, h = (r["p"], r["q"]), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(r["ids"])
            if at:
                yield *at, h.hexdigest()

        yield from arrow_rows(rows(), "p long, q long, ends_sha256 string")

    n = shuffle_partitions(ends.sparkSession)
    chunks = ends.repartitionByRange(n, "p", "q", "conv_id").sortWithinPartitions("p", "q", "conv_id").mapInArrow(chunk, "p long, q long, first long, ids binary")
    return chunks.repartition("p", "q").sortWithinPartitions("p", "q", "first").mapInArrow(digest, "p long, q long, ends_sha256 string")


def _told(rows: DataFrame, facts: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` by ``keys``, by a hash beside them: both sides are dealt for this join alone, so Spark can split a key of very many rows."""
    return rows.withColumn("_h", F.xxhash64(*keys)).join(facts.withColumn("_h", F.xxhash64(*keys)), ["_h", *keys], how).drop("_h")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", borrow: Borrow = GIVEN,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node of the trie of rebuilt conversations.

    Turns of one conversation are in the order of ``turn``, null first, equal ones in the order of their digests. A null role or text is empty. Rows
    without a conversation's id belong to none and are left out; repeated rows are turns of their own. Conversations without turns are
    members of the root and end there. Other columns, whatever their names, are left out. No rows: no rows, not even a root.
    """
    given = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), F.size(words(F.col(text_col))).cast("long").alias("words")
    ).where("conv_id IS NOT NULL")
    spark: SparkSession = conversations.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    convs, turns = rebuilt(given, borrow)
    every = written(prefixes(turns), "prefixes")
    seen = screened(every, sketch(every, every.count()))
    root = [F.xxhash64(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("p", "q")]
    nil = F.lit(0).cast("long")
    roots = convs.select("conv_id", "length", nil.alias("depth"), *root, nil.alias("up_p"), nil.alias("up_q"), nil.alias("words"))

    # Of the tail that a conversation has alone, the first turn is kept; the rest follows from it. What may be shared is grouped exactly.
    tails = seen.where("alone").groupBy("conv_id").agg(F.min(F.struct("depth", "up_p", "up_q")).alias("x"), F.max("length").alias("length"))
    tails = written(tails.select("conv_id", "length", "x.*"), "tails")
    maybe = _told(seen.where("NOT alone").drop("alone"), tails.select("conv_id", F.col("depth").alias("_tail")), "conv_id", how="left")
    rows = written(maybe.where("_tail IS NULL OR depth < _tail").drop("_tail").unionByName(roots), "shared")
    node = rows.groupBy("p", "q").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("length").alias("deepest"), F.max("words").alias("words"),
        F.max("up_p").alias("up_p"), F.max("up_q").alias("up_q"),
    )
    nodes = written(node.withColumn("saves", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    born = nodes.where("depth > 0").select("conv_id", "depth", "up_p", "up_q").unionByName(tails.select("conv_id", "depth", "up_p", "up_q"))
    children = born.groupBy(F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("n_children"))
    owners = nodes.select(F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"))
    parents = written(_told(born, owners, "up_p", "up_q").select("conv_id", "depth", "parent_conv_id"), "parents")

    # What each conversation owns: the nodes that it is the smallest member of, and of them perhaps a leaf.
    owned = nodes.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.max((F.col("deepest") == F.col("depth")).cast("int")).alias("leaf"))
    owns = owned.unionByName(tails.select("conv_id", nil.alias("saves"), F.lit(1).alias("leaf"))).groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.max("leaf").cast("long").alias("leaf"))
    below = _told(rows.select("conv_id", "p", "q"), owns, "conv_id").groupBy("p", "q").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("n_leaves"))
    above = running(nodes.select("conv_id", "depth", "p", "q", "saves", F.col("saves").alias("own")), "conv_id", "depth", ["saves"]).select("p", "q", (F.col("saves") - F.col("own")).alias("above"))

    ends = _ends(rows.where("depth = length").select("p", "q", "conv_id"))
    key = ["p", "q"]
    joined = nodes.select(*key, "conv_id", "depth", "n_convs").join(below, key).join(above, key).join(children, key, "left").join(ends, key, "left").join(parents, ["conv_id", "depth"], "left")
    shared = joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", nil).alias("n_children"), "n_leaves", (F.col("saves") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )

    last = F.col("depth") == F.col("length")
    step = lambda d, parent: (
        "conv_id", d, parent, F.lit(1).cast("long").alias("n_convs"), F.when(last, nil).otherwise(nil + 1).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), nil.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    begin = tails.join(parents, ["conv_id", "depth"]).select(*step("depth", "parent_conv_id"))
    deeper = tails.where("depth < length").select("conv_id", "length", F.explode(F.sequence(F.col("depth") + 1, F.col("length"))).alias("depth"))
    return shared.unionByName(begin).unionByName(deeper.select(*step("depth", F.col("conv_id").alias("parent_conv_id"))))
