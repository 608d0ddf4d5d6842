"""Scalar text and URL functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import TRACKING


def words(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def content_hash(title: Column, description: Column) -> Column:
    """md5 of title and description in lower case, without white space around both; 32 hex digits."""
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.md5(F.regexp_replace(both, r"^\s+|\s+$", ""))


def host(url: Column) -> Column:
    """Host in lower case, every ``www.`` gone; null if the text is no URL."""
    return F.replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("www."), F.lit(""))


def canonical_url(url: Column) -> Column:
    """https, host in lower case without ``www.``, no tracking or empty parameters, the others sorted by name, no fragment or slash at the end.

    A text that is no URL only loses its slashes at the end; null and empty texts are empty.
    """
    pairs = F.transform(F.split(F.try_parse_url(url, F.lit("QUERY")), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    tail = F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise("")
    whole = F.concat(F.lit("https://"), host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), tail)
    return F.coalesce(F.regexp_replace(F.coalesce(whole, url), "/+$", ""), F.lit(""))


def safe_link(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).otherwise("#")


def last_full_sentence(text: Column) -> Column:
    """Text up to its last sentence end, closing quotes with it; unchanged if it has no sentence end."""
    cut = F.regexp_extract(text, "(?s)^.*[.!?…][\"'”’»)]*", 0)
    return F.when(cut != "", cut).otherwise(text)


def truncated(text: Column) -> Column:
    """Whether the last character ends no sentence; an empty text isn't truncated."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    return (bare != "") & ~bare.rlike("[.!?…\"'”’»)]$")


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)))


def fact_tokens(text: Column) -> Column:
    """Vulnerability ids and numbers, sorted, as often as they occur."""
    return F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)CVE-[0-9]{4}-[0-9]+|[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), lambda x: F.lower(x)))


def corrected_year(output: Column, source: Column) -> Column:
    """Struct(text, action): years that the source doesn't have are replaced if it has one year, flagged if it has several, left if none."""
    odd, own = F.array_except(years(output), years(source)), years(source)
    fixed = F.aggregate(odd, output, lambda acc, y: F.replace(acc, y, F.element_at(own, 1)))
    return F.struct(
        F.when((F.size(odd) > 0) & (F.size(own) == 1), fixed).otherwise(output).alias("text"),
        F.when((F.size(odd) == 0) | (F.size(own) == 0), "ok").when(F.size(own) == 1, "replaced").otherwise("flagged").alias("action"),
    )


def mostly_foreign(text: Column, letters: str, sample: int = 40, least: int = 8, share: float = 0.6) -> Column:
    """Whether a text is in plain ASCII words: none of ``letters``, and enough of its first words are letters A-Z only."""
    head = F.slice(words(text), 1, sample)
    plain = F.size(F.filter(head, lambda w: w.rlike("^[A-Za-z]+$")))
    return ~F.array_join(head, " ").rlike(f"[{letters}]") & (plain >= F.greatest(F.lit(float(least)), share * F.size(head)))


def shortened_title(title: Column, fillers: list[str], most: int = 8) -> Column:
    """Filler phrases are taken out in order while the title is longer than ``most`` words."""
    step = lambda t, f: F.when(word_count(t) > most, F.trim(F.regexp_replace(F.replace(t, f, F.lit(" ")), " +", " "))).otherwise(t)
    return F.aggregate(F.array(*[F.lit(x) for x in fillers]), title, step)


def clamped(value: Column, most: int) -> Column:
    """Rounded half to even and held between 0 and ``most``; what is no number is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.bround(value.try_cast("double")).cast("int"), F.lit(0))))


def timestamp_of(text: Column) -> Column:
    """UTC time of the feeds' date formats; without a zone it is UTC; null if none fits. The weekday's name is ignored."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", "")
    named = F.regexp_replace(bare, " (GMT|UTC|UT|Z)$", " +0000")
    forms = ["d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(named, F.lit(f)) for f in forms])


def local_day(ts: Column, zone: str = "+03:00") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "dd.MM.yyyy")


def floor_of(fresh: Column) -> Column:
    """Least items of a report: 45 % of the fresh supply, 4 to 10; 10 if the supply isn't known."""
    return F.greatest(F.lit(4), F.least(F.lit(10), F.coalesce(F.bround(0.45 * fresh).cast("int"), F.lit(10))))


def json_value(text: Column) -> Column:
    """The JSON value of an answer, as a variant: the whole text if it parses, else what a fence holds, else the first braces that are balanced.

    Thinking blocks are taken out first. Braces within strings count as braces. Null if nothing parses; an object that repeats a key doesn't.
    """
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    rest = F.substring(bare, F.instr(bare, "{"), F.length(bare))
    # Each piece up to a closing brace: how many are open after it, and where it ends; nothing more is added once none is.
    step = lambda acc, x: F.when(acc["open"] == 0, acc).otherwise(
        F.struct((acc["open"] + F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))) - 1).alias("open"), (acc["end"] + F.length(x) + 1).alias("end"))
    )
    pieces = F.split(rest, r"\}", -1)
    first = F.struct((F.length(F.get(pieces, F.lit(0))) - F.length(F.replace(F.get(pieces, F.lit(0)), F.lit("{"), F.lit(""))) - 1).alias("open"), (F.length(F.get(pieces, F.lit(0))) + 1).alias("end"))
    walked = F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 2)), first, step)
    balanced = F.when((F.instr(bare, "{") > 0) & (walked["open"] == 0), F.substring(rest, F.lit(1), walked["end"]))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(fenced), F.try_parse_json(balanced))


def casual_past(text: Column, allowed: list[str]) -> Column:
    """Words in the spoken past tense at the end of a sentence, without those that end in an allowed suffix."""
    found = F.regexp_extract_all(text, F.lit(r"(?iU)(\w+(?:d|t)[ıiuü](?:lar|ler)?)(?=[.!?…](?:\s|$))"), F.lit(1))
    return F.filter(found, lambda w: ~F.exists(F.array(*[F.lit(s) for s in allowed]), lambda s: F.endswith(F.lower(w), s)))


def without_commentary(text: Column, verbs: list[str]) -> Column:
    """A text without its last sentences that end in an evaluative word, one after another; if all do, as it is."""
    last = "|".join(f"\\Q{v}\\E" for v in verbs)
    bare = F.regexp_replace(text, rf"(?iU)(?:(?:^|(?<=[.!?…]))\s*[^.!?…]*\b(?:{last})[.!?…]+\s*)+$", "")
    return F.when(F.trim(bare) == "", text).otherwise(F.regexp_replace(bare, r"\s+$", ""))
