"""Spans of regular expressions in whole texts, with DataFrame functions only: no shuffle, no Python on the executors.

Positions are code points, from 0, ends exclusive. Where matches lie follows from the lengths of the matches and of the gaps between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,k:int,end:int,found:string>>"


def running(values: Column, joined: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """What stands before each element, joined: sums unless ``joined`` says otherwise. Of no element it is 0, so that it suits numbers from 0 on.

    In blocks of the root of their number, as appending copies an array.
    """

    def before(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda acc, v: F.array_append(acc, joined(F.element_at(acc, -1), v)))

    def whole(inner: Column) -> Column:
        return let(
            before(F.transform(inner, lambda p: F.element_at(p, -1))),
            lambda first: F.flatten(F.transform(inner, lambda p, k: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: joined(v, F.get(first, k))))),
        )

    def blocks(x: Column) -> Column:
        def cut_up(step: Column) -> Column:
            return let(F.transform(F.sequence(F.lit(0), F.size(x) - 1, step), lambda s: before(F.slice(x, s + 1, step))), whole)

        none = F.array().cast("array<int>")
        return F.when(F.size(x) > 0, let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int")), cut_up)).otherwise(none)

    return let(values, blocks)


#: Code points of a piece of a text that is cut in many places.
PIECE = 256


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that ``cut`` needn't walk it from its start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(held: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text in ``pieces``; places before or after the text are left out."""
    return let(
        F.struct(F.greatest(start, F.lit(0)).alias("a"), end.alias("b")),
        lambda x: F.when(
            x["b"] > x["a"],
            F.substring(F.array_join(F.slice(held, F.floor(x["a"] / PIECE).cast("int") + 1, (F.floor((x["b"] - 1) / PIECE) - F.floor(x["a"] / PIECE)).cast("int") + 1), ""), x["a"] % PIECE + 1, x["b"] - x["a"]),
        ).otherwise(F.lit("")),
    )


def matches(text: Column, k: int, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts, as SPAN with kind number ``k``. The pattern must not match an empty string."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        size = F.transform(found, lambda m: F.length(m))
        both = F.struct(gaps.alias("gap"), size.alias("size"))

        def out(x: Column) -> Column:
            before = running(F.zip_with(F.slice(x["gap"], 1, F.size(found)), x["size"], lambda g, s: g + s))

            return let(
                before,
                lambda b: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(b, i) + F.get(x["gap"], i)).alias("start"),
                        F.lit(k).alias("k"),
                        (F.get(b, i) + F.get(x["gap"], i) + F.get(x["size"], i)).alias("end"),
                        m.alias("found"),
                    ),
                ),
            )

        return let(both, out)

    none = F.array().cast(SPAN)
    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))
    return every if keep is None else F.filter(every, lambda s: keep(s["found"]))


def written(spans: Column, kinds: list[str]) -> Column:
    """Spans as kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of each span; of spans that overlap, in place of all they cover."""

    def put(x: Column) -> Column:
        before = running(F.transform(x["spans"], lambda s: s["end"]), F.greatest)  # how far the spans before reach
        gaps = F.filter(F.zip_with(x["spans"], before, lambda s, at: F.struct(at.alias("a"), s["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        last = F.struct(F.array_max(F.transform(x["spans"], lambda s: s["end"])).alias("a"), F.length(text).alias("b"))
        return F.array_join(F.transform(F.array_append(gaps, last), lambda g: cut(x["held"], g["a"], g["b"])), mark)

    return F.when(F.size(spans) > 0, let(F.struct(F.sort_array(spans).alias("spans"), pieces(text).alias("held")), put)).otherwise(text)
