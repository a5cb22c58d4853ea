"""Functions on CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"


def parse(cigar: Column) -> Column:
    """Array of (n, op); empty for ``*``."""
    # both strings are cut outside the lambda, which would compute them for each element
    sizes = F.split(F.translate(cigar, OPS, " " * len(OPS)), " ", -1)
    kinds = F.split(F.translate(cigar, "0123456789", ""), "")
    pairs = F.zip_with(sizes, kinds, lambda n, op: F.struct(n.try_cast("int").alias("n"), op.alias("op")))
    return F.filter(pairs, lambda x: x["n"].isNotNull())


def total(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of the given operations."""
    return F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"].isin(*kinds), x["n"]).otherwise(0))


def map_length(ops: Column) -> Column:
    return total(ops, "MID=X")


def reference_end(ops: Column, pos: Column) -> Column:
    return pos + total(ops, "MDN=X")


def divergence(nm: Column, nn: Column, ops: Column) -> Column:
    """Edits that are no ambiguous bases, for each aligned base."""
    return F.try_divide((nm - nn).cast("double"), map_length(ops))


def clip(ops: Column, last: bool = False, kinds: str = "SH") -> Column:
    """Length of the clip at one end, 0 if there is none."""
    end = F.try_element_at(ops, F.lit(-1 if last else 1))
    return F.coalesce(F.when(end["op"].isin(*kinds), end["n"]), F.lit(0))


def query_interval(ops: Column, read_length: Column, reverse: Column) -> Column:
    """(start, end) of the aligned part on the original strand of the read."""
    left, right = clip(ops, kinds="S"), clip(ops, True, "S")
    first, second = F.when(reverse, right).otherwise(left), F.when(reverse, left).otherwise(right)
    return F.struct(first.alias("start"), (read_length - second).alias("end"))


def aligned_pairs(ops: Column, pos: Column) -> Column:
    """Array of (query, ref) positions; -1 where one side has a gap."""
    zero = F.struct(
        F.lit(0).alias("q"), pos.cast("int").alias("r"), F.array().cast("array<struct<query:int,ref:int>>").alias("pairs")
    )

    def step(state: Column, x: Column) -> Column:
        on_query, on_ref = x["op"].isin(*"MIS=X"), x["op"].isin(*"MDN=X")
        used = F.when(x["op"].isin(*"HP") | (x["n"] == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), x["n"] - 1))
        made = F.transform(
            used,
            lambda k: F.struct(
                F.when(on_query, state["q"] + k).otherwise(-1).alias("query"), F.when(on_ref, state["r"] + k).otherwise(-1).alias("ref")
            ),
        )
        return F.struct(
            (state["q"] + F.when(on_query, x["n"]).otherwise(0)).alias("q"),
            (state["r"] + F.when(on_ref, x["n"]).otherwise(0)).alias("r"),
            F.concat(state["pairs"], made).alias("pairs"),
        )

    return F.aggregate(ops, zero, step, lambda s: s["pairs"])
