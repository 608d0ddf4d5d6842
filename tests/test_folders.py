"""Queries where a table is a folder of files, ids are large, or a bound is met exactly: each against its SQL twin."""

import duckdb
import pytest

from storyline.plans import registry

from .test_oracles import SF, rows_of

#: Columns that tables here have, with the rows of the given tables moved to larger ids.
SHIFT = {"documents": ("doc_id", 300_000), "pages": ("page_id", 300_000), "events": ("event_id", 0)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("folders"), duckdb.connect()
    for name, (key, by) in SHIFT.items():
        (path / f"{name}.parquet").mkdir()
        for k in range(3):
            con.execute(f"COPY (SELECT * REPLACE ({key} + {by} AS {key}) FROM '{SF}/{name}.parquet' WHERE {key} % 3 = {k}) TO '{path}/{name}.parquet/part-{k}.parquet' (FORMAT PARQUET)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["stream_links", "stream_history", "stream_unseen", "page_links"])
def test_folders_of_files_and_large_ids(spark, folder, name):
    path, con = folder
    got, result = registry.QUERIES[name](spark, path), con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert rows_of(got.columns, got.collect()) == rows_of(names, result.fetchall())


def test_a_rewrite_of_exactly_55_percent_is_accepted(spark):
    from pyspark.sql import functions as F

    from storyline.functions.predicates import accepts_rewrite

    rows = [(" ".join(["w"] * (20 * k)), " ".join(["w"] * (11 * k)), " ".join(["w"] * (11 * k - 1))) for k in range(2, 60)]
    none = F.array().cast("array<string>")
    got = spark.createDataFrame(rows, "old string, new string, less string").select(accepts_rewrite(F.col("old"), F.col("new"), none), accepts_rewrite(F.col("old"), F.col("less"), none)).collect()
    assert [tuple(r) for r in got] == [(True, False)] * len(rows)
