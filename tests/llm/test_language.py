import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storyline.llm import language
from storyline.llm.language import fit, identified, ngrams, with_languages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.collect(), {r.doc_id: r for r in with_languages(docs).collect()}


def test_held_out_accuracy(found):
    docs, got = found
    assert len(got) == len(docs)
    right = Counter()
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        lettered = d.text is not None and any(c.isalpha() for c in d.text)
        assert (r.lang_pred == "und") == (not lettered)
        if r.held_out and lettered and d.lang:
            right[d.lang, r.lang_pred == d.lang] += 1
    for lang in {k[0] for k in right}:
        assert right[lang, True] >= 0.97 * (right[lang, True] + right[lang, False]), right
    assert sum(v for k, v in right.items() if k[1]) >= 0.99 * sum(right.values())


def plain(text, width):
    """n-grams one by one, over the whole text at once."""
    c = [ch if ch.isalpha() else " " for ch in text.lower()]
    c = [a for a, b in zip(c, [" ", *c], strict=False) if a != " " or b != " "]
    c = [" ", " ", *c]
    out = Counter()
    for k in range(2, len(c)):
        for n in (1, 2, 3):
            g = 0
            for ch in c[k - n + 1 : k + 1]:
                g = g << 21 | ord(ch)
            h = (g + n) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 32
            h = h * 0xD6E8FEB86659FD93 % 2**64
            out[(h >> 40) % width] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab  c, d!", "Ünïcode ÇĞ — 漢字 123 x", " lead and trail ", "A b\n" * 50])
def test_ngrams_of_windows(text, monkeypatch):
    want = plain(text, 512)
    for window in (1, 3, 7, 1 << 16):
        monkeypatch.setattr(language, "WINDOW", window)
        got = ngrams(text, 512)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)


def test_predictions_against_brute_force(spark, found):
    """Cosines with all centroids, from counts of n-grams one by one."""
    docs, got = found
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    model = fit(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    assert set(model.langs) == {"en", "de", "fr", "es"} and all(n > 1 for n in Counter(model.langs).values())
    for d in docs[::97]:
        if got[d.doc_id].lang_pred != "und":
            v = np.zeros(len(model.idf))
            for k, n in plain(d.text, len(model.idf)).items():
                v[k] = (1 + np.log(n)) * model.idf[k]
            cos = model.centroids @ (v / np.linalg.norm(v))
            assert got[d.doc_id].lang_pred == model.langs[int(cos.argmax())] and got[d.doc_id].score == pytest.approx(cos.max(), abs=1e-5)


def test_odd_rows(spark):
    words = {"xx": "la lo le li lu", "yy": "grk brk trk prk zrk"}
    rows = [(k, " ".join(words["xx" if k % 2 else "yy"].split()[(k + j) % 5] for j in range(30)), "xx" if k % 2 else "yy") for k in range(60)]
    far = [(100, "漢字仮名交じり文 " * 20, None), (101, None, "xx"), (102, "", "xx"), (103, "123 !? \n", "yy"), (None, "la lo le lu li la", "yy"), (None, None, None), (104, rows[1][1] * 20000, None), (105, "la lo", "xx")]
    every = rows + far + rows[:3]
    df = spark.createDataFrame([(i, t, y, "s", 0.5, True) for i, t, y in every], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean").repartition(4)
    out = defaultdict(list)
    for r in with_languages(df).collect():
        out[r.doc_id].append(r)
    assert sum(map(len, out.values())) == len(every) and len(out[0]) == 2 and len(out[None]) == 2
    assert all(out[i][0].lang_pred == y and not out[i][0].rejected for i, _, y in rows)
    assert all(out[i][0].lang_pred == "und" and out[i][0].score == 0 and not out[i][0].rejected for i in (101, 102, 103))
    assert out[100][0].rejected and out[100][0].lang_pred in ("xx", "yy") and out[104][0].lang_pred == "xx"
    assert sorted((r.lang_pred, r.held_out) for r in out[None]) == [("und", False), ("xx", False)]


def test_bounds_of_the_fit(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"{chr(97 + k % 9) * 3} {chr(98 + k % 9) * 2}", f"l{k % 9}") for k in range(900)] + [(None, "zz zzz", "l0")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, F.lit(True), sample=60, languages=5, centroids=3)
    assert len(set(model.langs)) == 5 and max(Counter(model.langs).values()) <= 3
    none = fit(df.where("false"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in identified(df, none).collect()} == {("und", 0.0)}
    assert with_languages(df.where("false")).count() == 0
