import re
from collections import Counter, defaultdict

from storyline.llm import quality_rules as q

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows, limits):
    norm = lambda x: re.sub("[0-9]+", "0", SPLIT.sub(" ", x.lower()).strip(" "))
    word_lines = lambda t: [x for x in (t or "").split("\n") if SPLIT.sub("", x)]
    hosts, held = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t)
        for x in word_lines(t):
            held[h, norm(x)].add(t)
    bad = {k for k, v in held.items() if len(v) >= limits.min_docs and 100 * len(v) > limits.max_percent * len(hosts[k[0]])}
    out = []
    for i, t, h in rows:
        w = [x for x in SPLIT.split(t or "") if x]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = word_lines(t)
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        gone = sum(len([y for y in SPLIT.split(x) if y]) for x in lines if (h, norm(x)) in bad)
        left = len(w) - gone
        kept = not failed and left >= limits.min_words and 100 * left >= limits.min_percent * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed, gone, kept))
    return out


def test_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    foot = "Copyright 20{} by\tus and all of them who wrote this"
    hard = [(10**6 + i, f"{foot.format(i)}\nown words of number {name(i)} a b c d e f g h {name(i)}x {name(i)}y\n\nshort {name(i)}", "h" if i % 3 else None) for i in range(90)]
    hard += [(10**7, None, "h"), (10**7 + 1, "", None), (None, "a b c d e " * 50, "h"), (None, None, None), (10**7 + 2, foot.format(7), "h"), (10**7 + 3, "😀é ##\n" * 4 + "x y z", "h")]
    rows = given + hard + hard[:5]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, source string, line string, pos int")
    limits = q.Limits()
    assert sorted(map(tuple, q.verdicts(df).collect()), key=repr) == sorted(brute(rows, limits), key=repr)
    kept = Counter((r[0], r[8]) for r in brute(rows, limits))
    got = q.cleaned(df)
    assert got.columns == df.columns
    got = got.collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for (i, k), n in kept.items() if k})
    assert not any("Copyright" in r.text for r in got if (r.doc_id or 0) >= 10**6)
    assert any("own words of number e " in r.text for r in got)


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert q.verdicts(df).count() == 0 and q.cleaned(df).count() == 0
    plan = q.verdicts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_count_alone_removes_a_line_on_large_hosts(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    own = lambda h, i: " ".join(f"{h}{name(i)}{x}" for x in "abcdefghijkl")
    rows = [(i, own("large", i) + "\nAll rights reserved by us" * (i < 25) + "\nSeen too seldom" * (100 <= i < 119), "large") for i in range(400)]
    rows += [(1000 + i, own("small", i) + "\nAll rights reserved by us" * (i < 25), "small") for i in range(60)]
    # Documents that are little else are depleted on a host of any size.
    rows += [(2000 + i, f"{own('large', 500 + i)}\n{'word ' * 3}{' '.join('abcdefghijklmnopqr')}", "large") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in q.verdicts(df).collect()}
    assert all(got[i] == (5 if i < 25 else 0, True) for i in range(400)) and all(got[1000 + i] == (5 if i < 25 else 0, True) for i in range(60))
    assert all(got[2000 + i] == (21, False) for i in range(20))
    texts = {r.doc_id: r.text for r in q.cleaned(df).collect()}
    assert not any("rights" in t for t in texts.values()) and sum("seldom" in t for t in texts.values()) == 19 and len(texts) == 460
