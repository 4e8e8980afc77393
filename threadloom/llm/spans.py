"""Matches of a pattern with their places in the text, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _SHUT, _OTHER = "\x01", "\x02", "\x03"
SPAN = "array<struct<start:int,end:int,m:string,pre:string,post:string>>"
_BLOCK = 256  # elements that one running total copies at a time
_FAR = 2**31 - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of int what ``step``, which is associative, makes of ``zero`` and all before it.

    An aggregate that appends copies what it has; in blocks of ``_BLOCK`` that is little for thousands of values.
    """
    empty = F.array().cast("array<int>")

    def within(x: Column, first: Column) -> Column:
        state = F.struct(first.cast("int").alias("at"), empty.alias("out"))
        more = lambda s, v: F.struct(step(s["at"], v).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(x, state, more, lambda s: s["out"])

    def blocked(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK)))

        def joined_up(blocks: Column) -> Column:
            whole = F.transform(blocks, lambda x: F.aggregate(x, F.lit(zero), lambda s, y: step(s, y).cast("int")))
            firsts = within(whole, F.lit(zero))
            return let(firsts, lambda f: F.flatten(F.transform(blocks, lambda x, k: within(x, F.element_at(f, k + 1)))))

        return let(cut, joined_up)

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, within(v, F.lit(zero))).otherwise(blocked(v)))


def found(text: Column, pattern: str, context: int = 24, asked: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, m, pre, post); code points, end exclusive.

    The pattern must not match the control characters U+0001 to U+0003. pre is what stands before a
    match, at most ``context`` characters and not further back than the match before; post is the next
    character. ``asked`` is a cheap necessary condition for a match.
    """
    safe = F.translate(text, _OPEN + _SHUT, _OTHER + _OTHER)
    split = F.split(F.regexp_replace(safe, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN, -1)  # all but the first: match, mark, what follows

    def spans(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda x, k: F.length(x) - F.when(k > 0, 1).otherwise(0))

        def span(k: Column, starts: Column) -> Column:
            piece, last = F.element_at(pieces, k + 1), F.element_at(pieces, k)
            size, start = F.instr(piece, _SHUT) - 1, F.element_at(starts, k + 1)
            return F.struct(
                start.alias("start"), (start + size).alias("end"), F.substring(piece, F.lit(1), size).alias("m"),
                F.right(F.substring(last, F.instr(last, _SHUT) + 1, F.length(last)), F.lit(context)).alias("pre"),
                F.substring(piece, size + 2, F.lit(1)).alias("post"),
            )

        places = F.sequence(F.lit(1), F.size(pieces) - 1)
        return let(scan(sizes, 0, lambda s, x: s + x), lambda starts: F.transform(places, lambda k: span(k, starts)))

    has = text.rlike(pattern) if asked is None else asked & text.rlike(pattern)
    return F.when(has, let(split, spans)).otherwise(F.array()).cast(SPAN)


def apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (structs with start and end) that overlap none of ``base``, in the order of start."""

    def merged(pair: Column) -> Column:
        mark = lambda rows, mine: F.transform(rows, lambda x, k: F.struct(x["start"].alias("s"), F.lit(mine).alias("mine"), x["end"].alias("e"), k.alias("k")))
        order = F.array_sort(F.concat(mark(pair["base"], 0), mark(pair["spans"], 1)))

        def free(rows: Column) -> Column:
            ends = scan(F.transform(rows, lambda x: F.when(x["mine"] == 0, x["e"]).otherwise(0)), 0, F.greatest)
            firsts = F.reverse(F.transform(rows, lambda x: F.when(x["mine"] == 0, x["s"]).otherwise(_FAR)))
            both = F.struct(ends.alias("before"), F.reverse(scan(firsts, _FAR, F.least)).alias("after"))
            kept = lambda y: F.filter(
                rows, lambda x, k: (x["mine"] == 1) & (F.element_at(y["before"], k + 1) <= x["s"]) & (F.element_at(y["after"], k + 1) >= x["e"])
            )
            return let(both, kept)

        return F.transform(let(order, free), lambda x: F.element_at(pair["spans"], x["k"] + 1))

    few = lambda pair: F.filter(
        pair["spans"], lambda x: ~F.exists(pair["base"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )
    sort = lambda pair: F.array_sort(
        few(pair), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"])
    )
    pair = F.struct(spans.alias("spans"), base.alias("base"))
    return let(pair, lambda p: F.when(F.size(p["base"]).cast("long") * F.size(p["spans"]) <= 4 * _BLOCK, sort(p)).otherwise(merged(p)))


def joined(spans: Column, names: list[str]) -> Column:
    """Sorted spans (kind, start, end; kind a number) as kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ","
    )
