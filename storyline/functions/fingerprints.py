"""Fingerprints of an article as arrays of distinct tokens, and how alike two of them are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import ACTOR_ID, ACTOR_SUFFIX_DENY, ACTOR_SUFFIXES, ADVISORY_ID, BODY_CHARS, BULLETIN, BULLETIN_FILL, ECOSYSTEM, LEAD_STEMS, PACKAGE_WINDOW, Lexicon

TOKEN = "[0-9a-zçğıöşü]+"
CAPITAL = "A-ZÇĞİÖŞÜ"
LETTER = "A-Za-zÇĞİÖŞÜçğıöşü"
# Actors named after weather; from how many words on, and of which share of capitals, a sentence is a title.
WEATHER = r"\b(?:Water|Earth|Void) [A-Z][a-z]{3,}\b"
TITLE_LEAST, TITLE_SHARE = 4, 0.6
# The same patterns, which look at a letter first and at more only where one of theirs can start.
ACTOR = ACTOR_ID.replace("(?i)", "(?i)(?=[uctdsafg])", 1)
ADVISORY = ADVISORY_ID.replace("(?i)", "(?i)(?=[civmkrdu])", 1)
SIGN = rf"(?=[npcrgmhvkd])(?<![a-z0-9_])(?:{ECOSYSTEM})(?![a-z0-9_])"
TAXONOMY = rf"(?=[A-Z])\b([A-Z][A-Za-z]{{2,}}\s+(?:{'|'.join(ACTOR_SUFFIXES + [x.upper() for x in ACTOR_SUFFIXES])}))\b"


def _among(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _let(x: Column, f) -> Column:
    """f(x), x being worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words, with one blank between them; the rest of the text isn't looked at."""
    head = F.regexp_extract(text, rf"^\s*+(?:\S++\s++){{0,{n - 1}}}+\S*+", 0)
    return F.array_join(F.slice(F.regexp_extract_all(head, F.lit(r"\S+"), F.lit(0)), 1, n), " ")


def codenames(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Campaign and malware names: words of five letters and more in camel case or capitals, that no deny list has."""
    lexicon = lexicon or Lexicon()
    deny = list(lexicon.codename_deny + lexicon.acronym_deny)
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), ADVISORY, " "), F.lit("[A-Za-z][A-Za-z0-9]{4,}"), F.lit(0))
    named = F.filter(found, lambda w: w.rlike("[a-z][A-Z]") | w.rlike("^[A-Z]+$"))
    low = F.transform(named, lambda w: F.lower(w))
    return F.array_distinct(F.filter(low, lambda w: ~w.isin(deny) & ~w.rlike(r"^[a-z]{1,4}aas$") & ~w.rlike(r"^(.)\1*$")))


def actors(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Actor and vulnerability ids, in lower case without blanks and dashes."""
    lexicon = lexicon or Lexicon()
    raw = F.coalesce(text, F.lit(""))
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(F.lower(x), r"[\s-]", ""))
    ids = bare(F.regexp_extract_all(F.lower(raw), F.lit(ACTOR), F.lit(0)))
    named = _let(F.lower(raw), lambda low: F.filter(_among(lexicon.named_actors), lambda n: F.contains(low, n)))
    weather = bare(F.regexp_extract_all(raw, F.lit(WEATHER), F.lit(0)))
    taxonomy = F.filter(bare(F.regexp_extract_all(raw, F.lit(TAXONOMY), F.lit(1))), lambda x: ~x.isin(ACTOR_SUFFIX_DENY))
    return F.array_distinct(F.concat(ids, F.transform(named, lambda n: F.replace(n, F.lit(" "), F.lit(""))), weather, taxonomy))


def keywords(text: Column, limit: int | None = None, lexicon: Lexicon | None = None) -> Column:
    """Distinct five-letter stems of words of four letters and more that aren't stop words; the first ``limit`` of them."""
    stop = list((lexicon or Lexicon()).stop_words)
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ACTOR, " ")
    # Short words aren't even cut out; a list of this length is looked up as a hash set.
    kept = F.filter(F.regexp_extract_all(clean, F.lit(TOKEN.replace("+", "{4,}")), F.lit(0)), lambda t: ~t.isin(stop))
    stems = F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, 5)))
    return stems if limit is None else F.slice(stems, 1, limit)


def title_stems(title: Column) -> Column:
    """Distinct five-letter stems of the title's words of five letters and more."""
    low = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"\S+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(low, lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5)))


def title_ids(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"cve-\d{4}-\d+"), F.lit(0)))


def title_versions(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"\d+\.\d+[\.\d]*"), F.lit(0)))


def bulletin_product(text: Column) -> Column:
    """Stems of the product that a vulnerability bulletin's title names."""
    name = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), BULLETIN, 1))
    kept = F.filter(F.regexp_extract_all(name, F.lit("[0-9a-zà-ÿ]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(BULLETIN_FILL))
    return F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, 5)))


def entities(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Struct(certain, candidate) of eight-letter stems of capitalised words. Candidates stand only at the start of sentences.

    A mark is put before the words that start a sentence; then both kinds are plain matches.
    """
    lexicon = lexicon or Lexicon()
    deny = list(lexicon.entity_deny + lexicon.codename_deny)
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf'(^\s*|[.!?:;•\n]\s+|["“(]\s*)([{CAPITAL}])', "$1\u0001$2")
    token = rf"(?=[{CAPITAL}])(?<![{LETTER}0-9_\u0001])([{CAPITAL}][{LETTER}0-9]{{3,}})"
    stems = lambda p: F.array_distinct(F.transform(F.filter(F.transform(F.regexp_extract_all(marked, F.lit(p), F.lit(1)), lambda w: F.lower(w)), lambda w: ~w.isin(deny)), lambda w: F.substring(w, 1, 8)))
    certain, first = stems(token), stems(rf"\u0001([{CAPITAL}][{LETTER}0-9]{{3,}})")
    return F.struct(certain.alias("certain"), F.array_except(first, certain).alias("candidate"))


def proper_names(fields: list[Column], lexicon: Lexicon | None = None) -> Column:
    """Struct(certain, candidate) of eight-letter stems of capitalised words of the fields, sentence by sentence.

    Sentences of four words and more of which most have a capital are titles and are left out. The first word of a sentence is a candidate.
    """
    lexicon = lexicon or Lexicon()
    deny = list(lexicon.entity_deny + lexicon.codename_deny + lexicon.acronym_deny)
    sentences = F.flatten(F.array(*[F.split(F.coalesce(f, F.lit("")), r"(?<=[.!?])\s+|\n+", -1) for f in fields]))

    def plain(x: Column) -> Column:
        n = lambda p: F.size(F.regexp_extract_all(x, F.lit(p), F.lit(0)))
        return _let(n(r"\S+"), lambda k: (k < TITLE_LEAST) | (n(r"(?=\p{Lu})(?<!\S)\p{Lu}\S*") <= TITLE_SHARE * k))

    def stems(kept: Column, pattern: str) -> Column:
        found = F.flatten(F.transform(kept, lambda x: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda w: F.lower(w))))
        return F.array_distinct(F.transform(F.filter(found, lambda w: ~w.isin(deny)), lambda w: F.substring(w, 1, 8)))

    word = rf"([{CAPITAL}][{LETTER}0-9]{{3,}})"

    def both(kept: Column) -> Column:
        certain, first = stems(kept, rf"(?=[{CAPITAL}])(?<=[^\p{{L}}\p{{N}}_])" + word), stems(kept, "^" + word)
        return F.struct(certain.alias("certain"), F.array_except(first, certain).alias("candidate"))

    return F.element_at(F.transform(F.array(F.filter(sentences, plain)), both), 1)


def actor_stems(text: Column, found: Column, lexicon: Lexicon | None = None) -> Column:
    """Eight-letter stems of the words of a text's actors, of which names of events aren't made. found: its ``actors``."""
    lexicon = lexicon or Lexicon()
    raw = F.coalesce(text, F.lit(""))
    own = F.filter(found, lambda a: ~a.startswith("cve"))
    named = _let(F.lower(raw), lambda low: F.flatten(F.transform(F.filter(_among(lexicon.named_actors), lambda n: F.contains(low, n)), lambda n: F.split(n, " "))))
    taxonomy = F.transform(F.regexp_extract_all(raw, F.lit(TAXONOMY), F.lit(1)), lambda x: F.regexp_extract(x, "^[A-Za-z]+", 0))
    weather = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(WEATHER), F.lit(0)), lambda w: F.split(w, " ")))
    return F.array_distinct(F.transform(F.concat(own, named, taxonomy, weather), lambda w: F.substring(F.lower(w), 1, 8)))


def story_entities(body: Column, source: Column, lexicon: Lexicon | None = None, chars: int | None = None) -> Column:
    """Distinctive names of a story: certain and candidate ones of five letters and more, without the story deny list. chars: how much of the source is looked at, all of it if not given."""
    both = entities(F.concat_ws(" . ", F.when(body != "", body), source if chars is None else F.substring(source, 1, chars)), lexicon)
    return F.filter(F.array_except(F.array_union(both["certain"], both["candidate"]), _among((lexicon or Lexicon()).story_deny)), lambda x: F.length(x) >= 5)


def package_names(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Names in lower case near a sign of a package ecosystem. Needs the matches' places, so it is an Arrow function."""
    deny = frozenset((lexicon or Lexicon()).package_deny + (lexicon or Lexicon()).codename_deny)
    letters = "A-Za-zçğıöşüÇĞİÖŞÜ"

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        sign = re.compile(rf"\b(?:{ECOSYSTEM})\b", re.I)
        name = re.compile(rf"(?<![{letters}0-9@])@?[a-z][a-z0-9]*(?:[-_./][a-z0-9]+)*(?![{letters}0-9])")

        def one(t: str | None) -> list[str]:
            signs = [m.span() for m in sign.finditer(t or "")]
            near = lambda m: any(m.start() - PACKAGE_WINDOW <= b and a <= m.end() + PACKAGE_WINDOW for a, b in signs)
            found = {m[0].lstrip("@") for m in name.finditer(t) if near(m)} if signs else set()
            return sorted(w for w in found if len(w) >= 4 and w not in deny and not sign.fullmatch(w))

        for texts in batches:
            yield texts.map(one)

    # Texts without a sign have no names; they don't go to Python. Letters of all cases are made small ones here, as by far most texts have no sign.
    return F.coalesce(of(F.when(F.lower(F.upper(F.translate(text, "İ", "i"))).rlike(SIGN), text)), F.array().cast("array<string>"))


def bundle(out_title: Column, out_body: Column, src_title: Column, src_body: Column) -> Column:
    """All that a view says, as one text."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (F.coalesce(F.when(out_title != "", out_title), src_title), out_body, src_title, F.substring(src_body, 1, BODY_CHARS))])


def keyword_sets(body: Column, blob: Column) -> Column:
    """The three sets of stems whose overlaps make the topic, from the ``keywords`` of the body and of all text."""
    return F.struct(body.alias("body"), blob.alias("blob"), F.slice(body, 1, LEAD_STEMS).alias("lead"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def topic(a: Column, b: Column) -> Column:
    """The largest overlap of two articles' three keyword sets."""
    return F.greatest(*[jaccard(a[k], b[k]) for k in ("body", "blob", "lead")])


def shared_entities(a: Column, b: Column) -> Column:
    """Names both have, certain in one of them at least."""
    return F.array_union(F.array_union(F.array_intersect(a["certain"], b["certain"]), F.array_intersect(a["certain"], b["candidate"])), F.array_intersect(a["candidate"], b["certain"]))


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two titles in lower case by longest matching blocks; the order of the two matters."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def template_only(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two titles are alike only by a template: a common start of 15 characters without a name or number in it, and what differs differs."""
    from difflib import SequenceMatcher
    from os.path import commonprefix

    def one(x: str | None, y: str | None) -> bool:
        x, y = (x or "").strip(), (y or "").strip()
        n = len(commonprefix([x.lower(), y.lower()]))
        named = any(w and (w[0].isupper() or any(c.isdigit() for c in w)) for w in (t.strip(".,:;()[]\"'«»") for t in x[:n].split()[1:]))
        p, q = x.lower()[n:].strip(), y.lower()[n:].strip()
        if n < 15 or named or not p or not q:
            return False
        m = len(commonprefix([p[::-1], q[::-1]]))
        p2, q2 = p[: len(p) - m].strip(), q[: len(q) - m].strip()
        p, q = (p2, q2) if p2 and q2 else (p, q)
        return SequenceMatcher(None, p, q).ratio() < 0.5

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")
