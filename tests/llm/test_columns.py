"""Tables with extra columns of any name: operators that return a table's columns keep them as they are."""

import pytest
from pyspark.sql import functions as F

from storyline.llm import mixing, pii, quality_rules, secret_scan, simhash

#: Every name that an operator uses inside, or adds.
NAMES = (
    "_0 _1 _2 _3 _4 _doc _w _l _key _cuts _kept _n _base _odd _secrets _pii _spans id host doc w l lines line gone n_gone pos x n n_docs n_host found base odd spans key cuts pass block tokens "
    "passes kept fp fingerprint component_id least root node start end k score row d m n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_removed_words "
    "mix_pass mix_block mix_order mix_tokens secrets pii n_tokens weight quota bucket offset a.b"
).split()
ADDED = {"mixed": mixing.ADDED, "rules": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], "secrets": ["secrets"], "pii": ["pii"]}
OPERATORS = {
    "cleaned": quality_rules.cleaned,
    "rules": quality_rules.text_rules,
    "mixed": lambda d: mixing.mixed(d, tokens=F.length("text"), mix=mixing.Mix(max_repeats=2.0)),
    "once": simhash.drop_near_duplicates,
    "redacted": secret_scan.redacted,
    "secrets": secret_scan.with_secrets,
    "masked": pii.redacted,
    "pii": pii.with_personal_data,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_stay(spark, name):
    text = "this is text number {} of a few that we write to a@b.cd with token=abcdef{} in it and some more words"
    rows = [(i, text.format(i, i) + "\nfoot line of all the pages here" if i % 7 else None, "s" if i % 3 else None) for i in range(40)] + [(None, "x", "s"), (3, text.format(3, 3), "s")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    operator, added = OPERATORS[name], ADDED.get(name, [])
    want = operator(plain)
    got = operator(extra)
    kept = [c for c in extra.columns if c not in added]
    assert got.columns == kept + added
    own = [f"`{c}`" for c in want.columns]
    assert sorted(map(repr, got.select(*own).collect())) == sorted(map(repr, want.collect()))
    assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got.collect() for c in NAMES if c not in added)
    assert operator(got.limit(3)).columns == got.columns
