"""Checkpoints, connected components and first-wins selection over tables of links."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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
    """Cut the lineage in the shared folder, which outlives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a wide table as Parquet in the shared folder: repeated tokens are small there, and readers get the columns that they ask for."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def run_key(by: Sequence[str]) -> Column:
    """Text that names a run by its ``by`` columns, nulls included; empty without any."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected ``edges`` (a, b); root is the component's smallest node. Labels jump to their label's label in each round."""
    both = checkpointed(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        least = now.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("root"))
        hop = least.select(F.col("node").alias("at"), F.col("root").alias("next"))
        after = checkpointed(least.join(hop, F.col("root") == F.col("at")).select("node", F.col("next").alias("root")))
        moved = after.alias("x").join(now.alias("y"), "node").where("x.root <> y.root").isEmpty()
        now = after
        if moved:
            return now


def first_wins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, accepted): in the order of ids, a node is accepted unless an earlier accepted node has an edge to it.

    nodes: (id). edges: (a, b) with a < b. The same result as walking the nodes in order: a node with no undecided earlier neighbour is accepted,
    and all later neighbours of accepted nodes are rejected, until all are decided: at least the first open node is in each round.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    state = checkpointed(nodes.select("id").distinct().withColumn("accepted", F.lit(None).cast("boolean")))
    while True:
        open_ = state.where("accepted IS NULL").select("id")
        if open_.isEmpty():
            return state
        waiting = edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        accept = open_.join(waiting, "id", "left_anti").withColumn("_in", F.lit(True))
        reject = edges.join(accept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("_out", F.lit(True))
        state = checkpointed(
            state.join(accept, "id", "left").join(reject, "id", "left").select("id", F.coalesce("accepted", F.when(F.col("_in"), True), F.when(F.col("_out"), False)).alias("accepted"))
        )
