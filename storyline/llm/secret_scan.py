"""Secrets: key patterns, and sliding-window Shannon entropy over candidate strings with an allow-list. DataFrame functions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, put_back, set_apart
from .spans import count, masked, matches, running, written

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]

# Base kinds, candidate strings, and what is allowed though its entropy is high.
NAMES = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9_/+=-]+$",  # no letters: numbers, dates, rules
    r"^[A-Za-z_/+=-]+$",  # no digits: words, paths
    r"(?i)example|sample|placeholder|changeme|x{4}|0{6}|1234567",
    r"^sha(1|256|384|512)-",  # integrity digests
]
#: Characters of a window, and bits a character from which it counts as random, by character class: hexadecimal, letters and digits, base64.
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
SCALE = 1_000_000
#: SCALE * c * log2(c), in whole numbers, so that sums are exact in any order.
PLOG = [round(SCALE * c * log2(c)) if c else 0 for c in range(WINDOW + 2)]


def limit(bits: float) -> int:
    """A window has ``bits`` a character or more if the PLOG of its counts add up to this at most."""
    return round(SCALE * WINDOW * (log2(WINDOW) - bits))


def hot_range(c: Column) -> Column:
    """First and last 1-based end of windows of a string that are random for its class; nulls if none is.

    The counts of the distinct characters move with the window: one character enters, one leaves.
    """
    most = F.when(c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), limit(BITS["hex"])).when(c.rlike("^[A-Za-z0-9]+$"), limit(BITS["alnum"])).otherwise(limit(BITS["base64"])).cast("long")
    plog = F.array(*[F.lit(x).cast("long") for x in PLOG])

    def slid(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            come = F.get(x["at"], i)
            gone = F.when(i >= WINDOW, F.get(x["at"], i - WINDOW)).otherwise(F.lit(-1))

            def moved(y: Column) -> Column:
                a = F.get(acc["n"], y["come"])
                b = F.get(acc["n"], y["gone"]) + F.when(y["come"] == y["gone"], 1).otherwise(0)
                total = acc["sum"] + F.get(plog, a + 1) - F.get(plog, a) + F.when(y["gone"] >= 0, F.get(plog, b - 1) - F.get(plog, b)).otherwise(F.lit(0).cast("long"))

                def noted(s: Column) -> Column:
                    hot = (i >= WINDOW - 1) & (s <= x["most"])
                    return F.struct(
                        F.transform(acc["n"], lambda v, j: v + F.when(j == y["come"], 1).otherwise(0) - F.when(j == y["gone"], 1).otherwise(0)).alias("n"),
                        s.alias("sum"),
                        F.when(hot & acc["first"].isNull(), i + 1).otherwise(acc["first"]).alias("first"),
                        F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
                    )

                return let(total, noted)

            return let(F.struct(come.alias("come"), gone.alias("gone")), moved)

        none = F.lit(None).cast("int")
        start = F.struct(F.transform(x["set"], lambda _: F.lit(0)).alias("n"), F.lit(0).cast("long").alias("sum"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["at"]) - 1), start, step, lambda acc: F.struct(acc["first"], acc["last"]))

    def numbered(chars: Column) -> Column:
        return let(
            F.array_distinct(chars),
            lambda s: let(F.struct(F.transform(chars, lambda ch: (F.array_position(s, ch) - 1).cast("int")).alias("at"), s.alias("set"), most.alias("most")), slid),
        )

    return let(F.filter(F.split(c, ""), lambda ch: ch != ""), numbered)


def _random(candidates: Column) -> Column:
    """Candidates cut to what their random windows cover."""
    ok = F.filter(candidates, lambda s: ~_any(s["found"]))
    placed = F.transform(
        ok,
        lambda s: let(
            hot_range(s["found"]),
            lambda h: F.struct((s["start"] + h["first"] - WINDOW).alias("start"), s["k"], (s["start"] + h["last"]).alias("end"), s["found"]),
        ),
    )
    return F.filter(placed, lambda s: s["start"].isNotNull())


def _any(found: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | found.rlike(pattern)
    return out


def _uncovered(spans: Column) -> Column:
    """Spans, but for those of entropy that a base span covers: one that starts no later and reaches as far."""

    def kept(x: Column) -> Column:
        before = running(F.transform(x, lambda s: F.when(s["k"] < len(BASE), s["end"]).otherwise(0)), F.greatest)
        return let(before, lambda b: F.filter(x, lambda s, i: (s["k"] < len(BASE)) | (F.get(b, i) < s["end"])))

    return let(spans, kept)


def with_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with an array of struct<start, k, end, found> in ``into``, by start and kind; k counts KINDS.

    Base kinds are assign, access and hex. entropy spans are added where no base span covers them: strings of 20 characters and more, cut
    to the windows whose entropy reaches the limit of their character class, unless the allow-list suppresses them. A null text has none. Repeated
    rows each get theirs. Long texts are looked at whole. Other columns stay as they are, whatever their names; a column of the name ``into`` is
    replaced. No rows: no rows.
    """
    own, name = set_apart(docs, text_col)
    text = F.coalesce(F.col(name), F.lit(""))
    assign = matches(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, "(?s)^" + ASSIGN + "$", 1)) >= 6)
    base = F.concat(assign, matches(text, 1, ACCESS), matches(text, 2, HEX))
    found = own.select("*", base.alias("base"), matches(text, 3, CANDIDATE).alias("odd"))
    more = F.when(F.size("odd") > 0, _uncovered(F.sort_array(F.concat("base", _random(F.col("odd"))))))
    return put_back(found, docs, **{into: F.coalesce(more, F.sort_array("base"))})


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base kinds, base_sha256, spans) for each row; other columns are left out. No rows: no rows."""
    found, spans = with_secrets(docs.select(id_col, text_col), text_col, "_spans"), F.col("_spans")
    counts = [count(spans, k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = F.filter(spans, lambda s: s["k"] < len(BASE))
    return found.select(id_col, *counts, F.sha2(written(base, KINDS), 256).alias("base_sha256"), written(spans, KINDS).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in the text replaced by ``mark``; a null text stays null, and so do all other columns. No rows: no rows."""
    own, text = set_apart(docs, text_col)
    found = with_secrets(own, text, "found")
    return put_back(found.withColumn(text, masked(F.col(text), F.col("found"), mark)), docs)
