"""Registered training-data queries that have an SQL twin against it, and that all of them are registered."""

import duckdb
import pytest

from storyline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in found.collect()), key=repr)
    assert got == want


def test_all_are_registered():
    import __spark_entry__

    have = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in have) for n in range(1, 14)) and "pipeline" in have
