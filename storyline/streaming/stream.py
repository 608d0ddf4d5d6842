"""The ingest as streams: seen links dropped once, late items admitted by source, funnels by window, ledgers by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.stories import event_ledger, event_representatives


def admitted(items: DataFrame, hours: DataFrame, now: str, base: int = 96) -> DataFrame:
    """Items within their source's hours before ``now``; of sources that aren't listed, ``base`` hours. Items without a time pass."""
    joined = items.join(hours, "source", "left")
    least = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.coalesce("hours", F.lit(base)))
    return joined.where(F.col("pub_ts").isNull() | (F.col("pub_ts") >= least)).drop("hours")


def window_hours(failed: DataFrame, slow: list[str], reports: DataFrame, now: Column, base: int = 96, wide: int = 168) -> DataFrame:
    """(source, hours): the wide window for sources that failed lately or are slow; the row without a source is for all others.

    Those have the base window, or the wide one if the last report before today is about that old: a day less or more. Without any report no time has
    been lost. failed: (source); reports: (day).
    """
    listed = failed.select("source").unionByName(failed.sparkSession.createDataFrame([(s,) for s in slow], "source string"))
    named = listed.where("source IS NOT NULL").distinct().select("source", F.lit(wide).alias("hours"))
    gap = F.date_diff(F.to_date(now), F.max("day"))
    rest = reports.where(F.col("day") < F.to_date(now)).agg(F.when(gap >= base // 24 - 1, wide).otherwise(base).alias("hours"))
    return named.unionByName(rest.select(F.lit(None).cast("string").alias("source"), "hours"))


def judged(items: DataFrame, hours: DataFrame, now: Column) -> DataFrame:
    """Items with ``late``: whether they are older than their source's hours, of ``window_hours``. Items without a time aren't late."""
    rest = hours.where("source IS NULL").agg(F.max("hours").alias("_rest"))
    named = hours.where("source IS NOT NULL").select("source", F.col("hours").alias("_hours"))
    least = now - F.make_dt_interval(F.lit(0), F.coalesce("_hours", "_rest"))
    return items.join(named, "source", "left").join(F.broadcast(rest)).withColumn("late", F.coalesce(F.col("pub_ts") < least, F.lit(False))).drop("_hours", "_rest")


def split_late(stream: DataFrame, hours: Callable[[int], DataFrame], now: Callable[[int], Column], path: str) -> DataFrame:
    """All items that the stream has now, with ``late``: one table under ``path``, partitioned by it, of which the admitted and the rejected are two sides.

    stream: (source, pub_ts, …). ``hours`` and ``now`` are asked for each micro-batch, so what they read may change while the stream runs. A micro-batch
    writes both sides in one pass and replaces its own folder, so one that comes twice leaves each item on one side, once. Called again with
    the same ``path`` it goes on where it stopped or was killed.
    """
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("late", BooleanType())])
    put_in = lambda rows, n: rows.select(schema.names).write.mode("overwrite").partitionBy("late").parquet(f"{path}/out/batch={n}")
    put_in(spark.createDataFrame([], schema), -1)
    daily(stream, lambda batch, n: put_in(judged(batch, hours(n), now(n)), n), f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").select(schema.names)


def unseen(items: DataFrame, key: str, days: int = 7) -> DataFrame:
    """Each key once within the watermark; state older than that goes."""
    return items.withWatermark("pub_ts", f"{days} days").dropDuplicatesWithinWatermark([key])


def fresh_links(items: DataFrame, ledger: DataFrame, days: int = 7) -> DataFrame:
    """Each link once within the watermark, without those of the ledger (url_norm) and blank ones. items: (pub_ts, url_norm, …)."""
    known = ledger.select("url_norm").distinct()
    return unseen(items.where(F.col("url_norm") != "").join(known, "url_norm", "left_anti"), "url_norm", days)


def funnel(items: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """(start, source, n, value) by window, tumbling or, with ``slide``, sliding."""
    by = items.withWatermark("pub_ts", late).groupBy(F.window("pub_ts", window, slide), "source")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "source", "n", "value")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there now, as a table under ``path``, which tasks and driver share.

    Each micro-batch replaces its own folder, so one that comes twice counts once; in complete mode the last one is the result.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else n}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def versioned(stream: DataFrame, start: DataFrame, update: Callable[[DataFrame, DataFrame], DataFrame], path: str) -> DataFrame:
    """A state table after all that the stream has now: ``update(state, batch)`` for each micro-batch, from ``start`` on.

    Each micro-batch reads the version before it and writes its own, so one that comes twice gives the same state; versions lie under ``path``,
    a new folder.
    """
    spark = stream.sparkSession
    version = lambda n: f"{path}/state={n}"
    start.write.parquet(version(-1))
    done = [-1]

    def put(batch: DataFrame, n: int) -> None:
        update(spark.read.schema(start.schema).parquet(version(n - 1)), batch).select(start.columns).write.mode("overwrite").parquet(version(n))
        done.append(n)

    daily(stream, put, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(start.schema).parquet(version(max(done)))


def ledgered(views: DataFrame, relate: Callable[[DataFrame, DataFrame], DataFrame], path: str, representatives: int = 3) -> DataFrame:
    """(id, event) of all views that the stream has now, as ``event_ledger`` of all of them gives, however the stream is cut.

    views: (id, …), streamed in the order of ids: none of a micro-batch is before one of an earlier. ``relate(batch, known)`` gives (a, b, relation), b of the
    batch, a of the batch or of known (id, event), the representatives of earlier events; a relation of two views mustn't depend on others. A
    micro-batch reads the representatives of the version before it and writes its own views' events and the next version, so one that comes twice
    has no effect; views that are in the ledger already are passed over. Called again with the same ``path`` it goes on where it stopped or was killed.
    """
    spark = views.sparkSession
    form, kept = "id long, event long", "event long, pos int, id long"
    version = lambda n: f"{path}/representatives={n}"
    ledger = lambda: spark.read.schema(f"{form}, batch long").parquet(f"{path}/ledger")
    spark.createDataFrame([], kept).write.mode("overwrite").parquet(version(-1))
    spark.createDataFrame([], form).write.mode("overwrite").parquet(f"{path}/ledger/batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        known = spark.read.schema(kept).parquet(version(n - 1)).select("id", "event")
        new = batch.join(ledger().where(F.col("batch") < n).select("id"), "id", "left_anti").dropDuplicates(["id"])
        out = f"{path}/ledger/batch={n}"
        event_ledger(new.select("id"), relate(new, known), representatives, known).select("id", "event").write.mode("overwrite").parquet(out)
        told = known.unionByName(spark.read.schema(form).parquet(out))
        event_representatives(told, representatives).write.mode("overwrite").parquet(version(n))

    daily(views, put, f"{path}/checkpoint").awaitTermination()
    return ledger().select("id", "event")


def written(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def daily(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``update`` for each micro-batch; it must be idempotent by day, as a batch can come twice."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
