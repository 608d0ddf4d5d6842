"""Rows and chunks whose flags are too near don't meet, and nothing is lost by that."""

import numpy as np
from pyspark.sql import functions as F

from storyline.operators import grid, resolve
from storyline.plans import events_plan as ep

from .test_counting import chunk
from .test_decided import held, rows_of  # noqa: F401


def test_rows_too_near_are_not_looked_at():
    (ids, _, fields), flags = chunk([{1, 2}, {2, 3}, {1, 3}, {2}]), np.array([0, 2, 0, 0])
    old, run = (ids, flags, fields), (ids + 10, flags * 0 + 2, fields)
    looked = []

    def decide(shared, n, m, p, q, later):
        looked.append(p)
        rows = shared.some(0)
        rows = rows[np.abs(q[rows] - p) >= 1]
        return rows, np.ones(len(rows))

    def pairs(*a):
        looked.clear()
        return sorted((int(a), int(b)) for x in grid._met(*a) for a, b in zip(x[0], x[1], strict=True)), len(looked)

    want, every = pairs(old, run, False, decide)
    assert pairs(old, run, False, decide, (1, 3)) == (want, every - 1) and want  # the one of the run meets none of it
    assert pairs(run, run, True, decide, (1, 3)) == ([], 0)
    assert pairs(old, run, False, decide, (0, 1)) == ([], 1)


def test_run_against_representatives(spark, held, monkeypatch):  # noqa: F811
    """As in ``ledger_matches``: one flag for all that is old, over several chunks."""
    monkeypatch.setattr(grid, "ALONE", 0)
    late = (ep.day("id") == 4).cast("int")
    a, b = held.select(F.struct("*").alias("y"), F.col("id").alias("a")), held.select(F.struct("*").alias("x"), F.col("id").alias("b"))
    every = a.join(b, (F.col("a") < F.col("b")) & (ep.day("a") < 4) & (ep.day("b") == 4))
    want = rows_of(resolve.same_event(every, cross_day=True).where("same"), "rule")
    assert rows_of(resolve.pairs_across(held, late, 1), "rule") == want and want
