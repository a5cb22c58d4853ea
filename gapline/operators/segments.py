"""Segments: the clipped and inserted pieces of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.deploy import ship
from gapline.operators import cigar_kernel
from gapline.operators.cigar_kernel import LEFT, MIDDLE


def valid(flag: Column) -> Column:
    """Neither unmapped nor secondary."""
    return flag.bitwiseAND(F.lit(4 | 256)) == 0


def overhang(kind: Column, matched: Column, total: Column) -> Column:
    """Aligned bases that anchor a segment."""
    return F.when(kind == LEFT, total).when(kind == MIDDLE, F.least(matched, total - matched)).otherwise(matched)


def _schema(df: DataFrame, more: str) -> str:
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, more])


def with_spans(alignments: DataFrame, *, pos: str = "pos", cigar: str = "cigar") -> DataFrame:
    """The alignments with aln_end, match_len and read_len, which are null where the CIGAR string is."""
    ship(alignments.sparkSession)
    at = [alignments.columns.index(c) for c in (cigar, pos)]
    return alignments.mapInArrow(lambda it: cigar_kernel.spans(it, *at), _schema(alignments, cigar_kernel.SPANS))


def extract_segments(
    alignments: DataFrame,
    *,
    flag: str = "flag",
    pos: str = "pos",
    cigar: str = "cigar",
    min_length: int = 100,
    min_overhang: int | None = None,
) -> DataFrame:
    """A row for each segment of a valid alignment, beside the alignment's columns.

    What describes the whole alignment (aln_end, match_len, read_len, aln_type,
    num_seg) is computed in the row before its segments are, so nothing is
    shuffled.  ``min_overhang`` drops badly anchored segments.
    """
    ship(alignments.sparkSession)
    good = alignments.filter(valid(F.col(flag)))
    at = [alignments.columns.index(c) for c in (cigar, pos)]
    return good.mapInArrow(lambda it: cigar_kernel.segments(it, *at, min_length, min_overhang), _schema(good, cigar_kernel.SEGMENTS))


def trim_region(start: Column, end: Column, length: Column, flank: int) -> Column:
    """[start - flank, end + flank) cut to the read."""
    return F.struct(F.greatest(F.lit(0), start - flank).alias("start"), F.least(length, end + flank).alias("end"))


def legacy_read_filter(flag: Column, mapq: Column) -> Column:
    return (flag.bitwiseAND(F.lit(256)) == 0) & (mapq > 0)


def legacy_segment_filter(length: Column, is_clip: Column, query_length: Column) -> Column:
    """Lengths from 50 to 11,000; a clip needs a query of 300."""
    return length.between(50, 11_000) & (~is_clip | (query_length >= 300))
