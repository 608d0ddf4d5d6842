"""Every registered query of the engine against its SQL twin in DuckDB, as the driver compares them; those without one must run."""

import duckdb
import pytest

from storyline.plans import events_plan, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    """A value as both engines have it, digit by digit: nothing is rounded, and whole numbers stay whole."""
    return v.item() if hasattr(v, "item") else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(shown(r[k]) for k in order) for r in rows), key=repr)


#: Queries on events start from the same pairs, which test_events holds against all pairs; of those without a twin, these are run.
RUN = set(registry.ORACLE_SQL) | (set(registry.QUERIES) - set(events_plan.QUERIES)) | {"same_events", "ledger_matches", "chain_matches", "shadow_clusters"}


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        got.write.format("noop").mode("overwrite").save()
        return
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want, found = rows_of(names, result.fetchall()), rows_of(got.columns, got.collect())
    assert sorted(got.columns) == sorted(names)
    assert len(found) == len(want) and found == want, [x for x in zip(found, want, strict=False) if x[0] != x[1]][:3]
