"""What several training-data operators share: folders, words, connected components, packed binary columns."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder if all run on this machine, else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="storyline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: it outlives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, also where the optimizer would copy it into a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order, as an array; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def set_apart(docs: DataFrame, *named: str) -> tuple:
    """``docs`` with its columns called _0, _1, …, which no operator calls its own, and what the ``named`` ones are called now."""
    have = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"_{k}" for k in range(len(have))]), *[f"_{have.index(c.lower())}" for c in named]


def put_back(out: DataFrame, docs: DataFrame, **more: Column) -> DataFrame:
    """The columns of ``docs`` under their own names, but for those that ``more`` replaces, and ``more``."""
    given = {c.lower() for c in more}
    kept = [F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in given]
    return out.select(*kept, *[v.alias(c) for c, v in more.items()])


def _told(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``. least: (u, m), one row each.

    Joined by a hash beside the node: then both sides are exchanged for this join alone, and Spark can split the partition of a node that has very
    many edges. On the node alone the minima would stay where they were aggregated, which takes that from it.
    """
    left, right = edges.withColumn("h", F.xxhash64("u")), least.select(F.xxhash64("u").alias("h"), "u", "m")
    return left.join(right, ["h", "u"]).drop("h")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: (node, root), root the smallest node; only nodes with an edge.

    Alternating large and small stars: each round links every node to the smallest of its neighbours, in a logarithmic number of rounds.
    Minima are taken before the shuffle, and joins are such that Spark splits those of a hot node. No edges: no rows. Loops and null ends are left out.
    """
    now = checkpointed(
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _told(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _told(large, low).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        )
        now = checkpointed(small.select("e.*").where("u <> v").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(df: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def arrow_rows(rows: Iterator[tuple], ddl: str, most: int = 4000, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, of at most ``most`` rows and about ``weight`` bytes. ``ddl`` as in Spark, of the types below."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "doubles": pa.list_(pa.float64()), "ints": pa.list_(pa.int32())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= most or size > weight:
            yield _record_batch(held, schema)
            held, size = [], 0
    if held:
        yield _record_batch(held, schema)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def arrow_dicts(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[dict]:
    """Rows of Arrow batches as dicts, few of them at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            yield from batch.slice(i, at_once).to_pylist()
