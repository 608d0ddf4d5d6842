"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, put_back, set_apart
from .spans import count, cut, masked, matches, pieces, written

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]

# What proposes a span. Runs are taken whole and only from their start or from the last match's end, which finds the same
# matches as the plain expressions do without trying each character of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
#: Score of a confirmed span by kind, what a context word adds, and the words; spans that the method adds need THRESHOLD.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "address|server|host|client|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|fax|mobile|telefon|tel",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
NEARBY, BONUS, THRESHOLD = 40, 0.35, 0.7


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """Remainder one of an account number: its first four characters go last, letters count 10 to 35."""

    def of(c: Column) -> Column:
        turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

        def step(acc: Column, ch: Column) -> Column:
            code = F.ascii(ch)
            return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.length(c).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch))) == 1)

    return let(F.regexp_replace(m, " ", ""), of)


def _octets(m: Column) -> Column:
    def small(p: Column) -> Column:
        return let(F.regexp_replace(p, "^0+", ""), lambda z: F.when(F.length(z) <= 3, F.concat(F.lit("0"), z).cast("int") <= 255).otherwise(False))

    return F.forall(F.split(m, r"\."), small)


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


def _scored(text: Column, kind: str, spans: Column) -> Column:
    """Spans of a kind with their score: that of the kind, more if a context word stands within NEARBY code points before or after."""

    def score(held: Column, s: Column) -> Column:
        around = F.lower(cut(held, s["start"] - NEARBY, s["end"] + NEARBY))
        return F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(around.rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0.0)))

    none = F.array().cast("array<struct<start:int,k:int,end:int,score:double>>")
    some = let(F.struct(spans.alias("spans")), lambda x: F.when(F.size(x["spans"]) > 0, let(pieces(text), lambda held: F.transform(x["spans"], lambda s: F.struct(s["start"], s["k"], s["end"], score(held, s).alias("score"))))).otherwise(none))
    return some


def with_personal_data(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array of struct<start, k, end, score> in ``into``, by start and kind; k counts KINDS.

    Base kinds (email, ip, card, phone) stay whatever their score. iban (mod-97) and ssn need a score of THRESHOLD; ssn gets there only with a
    context word. A null text has none. Repeated rows each get theirs. Long texts are looked at whole, in time that grows with their length. Other
    columns stay as they are, whatever their names; a column of the name ``into`` is replaced. No rows: no rows.
    """
    own, name = set_apart(docs, text_col)
    text = F.coalesce(F.col(name), F.lit(""))
    found = [
        matches(text, 0, EMAIL),
        matches(text, 1, IP, _octets),
        matches(text, 2, CARD, _card),
        matches(text, 3, PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
        matches(text, 4, IBAN, mod97),
        matches(text, 5, SSN),
    ]
    held = own.select("*", F.concat(*[_scored(text, kind, x) for kind, x in zip(KINDS, found, strict=True)]).alias("found"))
    return put_back(held, docs, **{into: F.filter(F.sort_array("found"), lambda s: (s["k"] < len(BASE)) | (s["score"] >= THRESHOLD))})


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base kinds, base_sha256, spans) for each row; other columns are left out. No rows: no rows."""
    found, spans = with_personal_data(docs.select(id_col, text_col), text_col, "_spans"), F.col("_spans")
    counts = [count(spans, k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = F.filter(spans, lambda s: s["k"] < len(BASE))
    return found.select(id_col, *counts, F.sha2(written(base, KINDS), 256).alias("base_sha256"), written(spans, KINDS).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[PERSONAL]") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``mark``; a null text stays null, and so do all other columns. No rows: no rows."""
    own, text = set_apart(docs, text_col)
    found = with_personal_data(own, text, "found")
    return put_back(found.withColumn(text, masked(F.col(text), F.col("found"), mark)), docs)
