"""Column functions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are folded at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The arrays of type ``kind`` that ``step`` makes of a state and each item in turn, end to end.

    ``step`` gives the next state too.  An array that grows by one at a time is
    copied each time, so items are taken in blocks: n items cost n times the
    block's size, plus the square of the number of blocks.
    """
    empty = F.array().cast(kind)

    def inner(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["out"], out).alias("out"))

    def outer(s: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(s["state"].alias("state"), empty.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    def whole(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))
        first = F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, first, outer, lambda s: s["out"]))).otherwise(empty)

    return let(items, whole)


def matches(text: Column, pattern: str) -> Column:
    """Array of (gap, hit): each match of the pattern, and the text between it and the one before."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
