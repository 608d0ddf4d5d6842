"""Streams over small files, one a micro-batch: states by version, links against a ledger, sliding windows."""

import random
from datetime import date, datetime
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from storyline.operators.stories import event_ledger
from storyline.sources import sinks
from storyline.streaming import stream

ITEMS = "day date, article_id long, pos long, title string, url_norm string"


@pytest.fixture
def files(spark, tmp_path):
    """A stream of three files: a day twice, so that the second run of it replaces the first."""
    rows = [
        [(date(2024, 1, 1), 1, 1, "one", "a"), (date(2024, 1, 1), 1, 2, "again", "a")],
        [(date(2024, 1, 2), 2, 5, "a long title", "b"), (date(2024, 1, 2), 3, 4, None, None)],
        [(date(2024, 1, 1), 4, 1, "new", "seen"), (date(2024, 1, 1), 5, 2, "", "")],
    ]
    for k, x in enumerate(rows):
        spark.createDataFrame(x, ITEMS).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_versions_replace_days_and_count_articles_once(spark, files, tmp_path):
    start = spark.createDataFrame([(date(2024, 1, 2), 9, 9, "old"), (date(2023, 12, 1), 8, 8, "gone"), (date(2023, 12, 31), 7, 7, "kept")], "day date, article_id long, pos long, title string")
    update = lambda history, batch: sinks.upserted_days(history, batch, F.lit("2024-01-02").cast("date"), 7, {"title": 6})
    got = stream.versioned(files, start, update, str(tmp_path / "state"))
    want = {(2, 2, "a long"), (2, 3, None), (31, 7, "kept")}
    rows = {(r.day.day, r.article_id, r.title) for r in got.collect()}
    # Files of a batch come in no order; either run of the first day may be the last, and only whole.
    assert rows in (want | {(1, 1, "one")}, want | {(1, 4, "new"), (1, 5, "")})


def test_no_files_leave_the_start(spark, tmp_path):
    start = spark.createDataFrame([], "day date, article_id long, pos long, title string")
    (tmp_path / "in").mkdir()
    none = spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in"))
    assert stream.versioned(none, start, lambda history, batch: history, str(tmp_path / "state")).count() == 0


def test_links_of_the_ledger_and_blank_ones_go(spark, files, tmp_path):
    ledger = spark.createDataFrame([("seen",), (None,)], "url_norm string")
    found = stream.fresh_links(files.withColumn("pub_ts", F.col("day").cast("timestamp")), ledger)
    assert sorted(r.url_norm for r in stream.drained(found.select("url_norm"), str(tmp_path / "out")).collect()) == ["a", "b"]


def test_sliding_windows_count_an_item_in_each(spark, files, tmp_path):
    items = files.select(F.col("day").cast("timestamp").alias("pub_ts"), F.lit("s").alias("source"), F.lit(1.5).alias("value"))
    got = stream.drained(stream.funnel(items, "2 days", "1 day"), str(tmp_path / "out"), "complete")
    assert {(r.start, r.n, r.value) for r in got.collect()} == {(datetime(2023, 12, 31), 4, 6.0), (datetime(2024, 1, 1), 6, 9.0), (datetime(2024, 1, 2), 2, 3.0)}


def test_hours_by_failures_slow_sources_and_the_gap_of_reports(spark):
    now = F.lit("2024-01-10 06:00:00").cast("timestamp")
    failed = spark.createDataFrame([("f",), ("f",), (None,)], "source string")
    value = lambda *days: {r.source: r.hours for r in stream.window_hours(failed, ["s"], spark.createDataFrame([(d,) for d in days], "day date"), now).collect()}
    assert value(date(2024, 1, 8), date(2024, 1, 10), None) == {"f": 168, "s": 168, None: 96}
    assert value(date(2024, 1, 7), date(2024, 1, 12)) == {"f": 168, "s": 168, None: 168}
    assert value() == {"f": 168, "s": 168, None: 96}


def test_late_items_keep_their_side_after_a_killed_run(spark, tmp_path):
    """Three files, one a micro-batch; the hours change with the second, at which the first run dies."""
    schema = "id long, source string, pub_ts timestamp"
    hour = lambda h: None if h is None else datetime.fromtimestamp(1_700_000_000 - 3600 * h)
    for k in range(3):
        rows = [(10 * k + i, s, hour(h)) for i, (s, h) in enumerate([("x", 1), ("x", 100), ("y", 100), (None, 100), ("x", None), ("y", 200)])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    now = lambda n: F.lit(1_700_000_000).cast("timestamp")
    table = lambda *rows: spark.createDataFrame(list(rows), "source string, hours int")
    wide, dead = table(("y", 168), (None, 96)), []

    def hours(n):
        if n == 1 and not dead:
            dead.append(n)
            raise RuntimeError("killed")
        return wide if n == 0 else table((None, 168))

    with pytest.raises(Exception, match="killed"):
        stream.split_late(items, hours, now, str(tmp_path / "out"))
    for _ in range(2):  # The second time there is nothing left to do.
        found = {r.id: r.late for r in stream.split_late(items, hours, now, str(tmp_path / "out")).collect()}
    assert len(found) == 18 == stream.split_late(items, hours, now, str(tmp_path / "out")).count()
    # One file each: in the first batch x and unnamed sources have 96 hours, y 168; later all have 168.
    late = sorted(tuple(i % 10 for i in sorted(found) if i // 10 == k and found[i]) for k in range(3))
    assert late == [(1, 3, 5), (5,), (5,)]


def test_no_files_split_to_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    none = spark.readStream.schema("id long, source string, pub_ts timestamp").parquet(str(tmp_path / "in"))
    assert stream.split_late(none, lambda n: None, lambda n: None, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("cuts", [[0, 60], [0, 7, 8, 30, 60], [0, 25, 50, 60]])
def test_a_ledger_is_the_same_however_the_stream_is_cut(spark, tmp_path, cuts):
    """Each file a micro-batch, the last one twice; the second micro-batch, or its repetition, dies once."""
    rng = random.Random(17)
    rel = {(a, b): rng.choice(["same", "new_development", "same_actor_other_event"]) for b in range(1, 60) for a in rng.sample(range(b), min(b, 2))}
    relations = spark.createDataFrame([(a, b, r) for (a, b), r in rel.items()], "a long, b long, relation string")
    want = {r.id: r.event for r in event_ledger(spark.range(60), relations).collect()}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    views = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def relate(batch, known):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("killed")
        old = batch.select("id").unionByName(known.select("id"))
        return relations.join(batch.select(F.col("id").alias("b")), "b", "left_semi").join(old.select(F.col("id").alias("a")), "a", "left_semi")

    put = lambda x, y: spark.range(x, y).coalesce(1).write.mode("append").parquet(source)

    def run():
        try:
            return stream.ledgered(views, relate, out)
        except Exception as e:
            assert "killed" in str(e)
            return stream.ledgered(views, relate, out)

    for x, y in pairwise(cuts):
        # One file at a time, as files of one run come in no sure order.
        put(x, y)
        assert {r.id: r.event for r in run().collect()} == {i: e for i, e in want.items() if i < y}
    put(cuts[-2], cuts[-1])
    rows = run().collect()
    assert len(rows) == 60 and {r.id: r.event for r in rows} == want and len(set(want.values())) < 60
