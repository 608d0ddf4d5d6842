import duckdb
import numpy as np
import pyarrow as pa
import pytest

from storyline.llm import prefix_trie as trie
from storyline.llm.oracles import TRIE
from storyline.llm.prefix_trie import Borrow, prefix_trie


def expected(rows):
    """All nodes by the SQL twin, which compares all prefixes with one another."""
    con = duckdb.connect()
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    con.register("conversations", pa.table({n: pa.array(c, t) for n, c, t in zip(["conv_id", "turn", "role", "text"], cols, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)}))
    result = con.execute(TRIE)
    names = [c[0] for c in result.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)


def nodes(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int").repartition(5)
    out = prefix_trie(df, **more)
    return sorted((tuple(r[c] for c in sorted(out.columns)) for r in out.collect()), key=repr)


def made(seed):
    rng = np.random.default_rng(seed)
    say = ["hello there", "how are you", "fine, and you ?", "", None, "bye bye now"]
    rows = []
    for c in [*range(45), 60, 61, 100, 1001, -3, 2**62]:
        for t in range(rng.integers(1, 6)):
            rows.append((c, t, ["user", "assistant", None][rng.integers(0, 3)] if rng.random() < 0.3 else "user", say[rng.integers(0, 2 if t < 2 else 6)]))
    same = [(c, t, "user", f"hot {t}") for c in range(200, 240) for t in range(9)]
    long = [(c, t, "user", f"turn {t % 7}") for c in (300, 301, 302, 303, 304) for t in range(30 + c % 3)]
    odd = [(None, 0, "user", "nobody's")] * 3 + [(400, None, "user", "first"), (400, 0, "user", "then"), (400, 0, "user", "a tie"), (400, 0, "user", "a tie")] + [(401, 5, "user", "x")] * 12
    return rows + same + long + odd


@pytest.mark.parametrize("block, least, most", [(4096, 1 << 16, 1 << 26), (4, 1 << 16, 1 << 26), (3, 64, 64), (5, 4, 4)])
def test_odd_rows(spark, monkeypatch, block, least, most):
    """Also in very short blocks, and with sketches so full that they prove some prefixes only, or none."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "LEAST", least)
    monkeypatch.setattr(trie, "MOST", most)
    rows = made(block)
    assert nodes(spark, rows) == expected(rows)


def test_other_rules_and_empty(spark):
    rows = [(c, t, "user", f"{t} {c if t > 2 else ''}") for c in range(4) for t in range(4)]
    none = Borrow(lambda c: c, lambda c: c * 0, 0)
    got = nodes(spark, rows, borrow=none)
    assert len(got) == 1 + 3 + 4 and max(r[5] for r in got) == 4
    assert nodes(spark, [(None, 1, "user", "x")]) == [] and nodes(spark, []) == []


def test_sketch_is_never_too_low(spark):
    rng = np.random.default_rng(1)
    keys = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (3000, 2))] + [(5, 6)] * 400
    df = spark.createDataFrame(keys, "p long, q long").repartition(7)
    for n in (1, len(keys), 10**6):
        c = trie.sketch(df, n)
        got = {(r.p, r.q): r.alone for r in trie.screened(df, c).collect()}
        assert not got[5, 6]
        assert min(int(c[cells[0]]) for cells in trie._cells(np.array([5]), np.array([6]), len(c) // trie.ROWS)) == trie.TOP
    assert sum(got.values()) == 3000
