"""Hits of segments against consensus sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(hits: DataFrame, *, key: Sequence[str] = ("seg_id",), start: str = "query_start", end: str = "query_end", ties: Sequence[str] = ()) -> DataFrame:
    """Hits with ``new_len``, the positions that no earlier hit of the key covers.

    The earlier hits reach as far as the largest end before, so the lengths add up
    to the length of the union.
    """
    order = Window.partitionBy(*key).orderBy(start, end, *ties)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return hits.withColumn("new_len", fresh)


def merge_hits(hits: DataFrame, *, key: Sequence[str] = ("seg_id",), start: str = "query_start", end: str = "query_end", ties: Sequence[str] = ()) -> DataFrame:
    """For each key: n_hits, sum_map, sum_divergence and sum_score over the hits that add positions."""
    fresh = union_length(hits, key=key, start=start, end=end, ties=ties)
    used = F.col("new_len") > 0
    return fresh.groupBy(*key).agg(
        F.count_if(used).alias("n_hits"),
        F.sum("new_len").alias("sum_map"),
        F.sum(F.when(used, F.col("divergence")).otherwise(0.0)).alias("sum_divergence"),
        F.sum(F.when(used, F.col("score") / F.col("map_len")).otherwise(0.0)).alias("sum_score"),
    )


def attach_hits(segments: DataFrame, merged: DataFrame, *, key: Sequence[str] = ("seg_id",)) -> DataFrame:
    """Segments with the sums of their hits, zero without any."""
    return segments.join(merged, list(key), "left").fillna(0, ["n_hits", "sum_map", "sum_divergence", "sum_score"])


def strand_votes(hits: DataFrame, *, key: Sequence[str], segment_reverse: str, hit_reverse: str) -> DataFrame:
    """For each key the numbers of hits on the segment's strand and on the other."""
    same = F.col(segment_reverse) == F.col(hit_reverse)
    return hits.groupBy(*key).agg(F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_opposite"))


def legacy_hit_score(spans: Column, read_fraction: Column, te_fraction: Column, mapq: Column, te_start: Column, divergence: Column) -> Column:
    """1 for a sound hit, 0.5 for a doubtful one, 0 for none.

    A hit of a spanning read needs a share of the element only.  A hit of a clip
    that leaves a quarter of it unaligned is doubtful; else it needs a near-perfect
    match, most of the clip, or enough of the element, less if it starts at its end.
    """
    covers = F.when(te_start <= 20, (te_fraction >= 0.1) & (mapq >= 30)).otherwise((te_fraction >= 0.25) & (mapq >= 60))
    sound = ((mapq < 30) & (divergence < 0.02)) | ((read_fraction > 0.6) & (mapq >= 40)) | covers
    clipped = F.when(read_fraction < 0.75, 0.5).when(sound, 1.0).otherwise(0.0)
    return F.when(spans, (te_fraction >= 0.15).cast("double")).otherwise(clipped)


def ltr_length(hits: DataFrame, *, te: str = "te_tid", ordinal: str = "ordinal") -> DataFrame:
    """Length of the LTR of each element from hits of its right half on its left half.

    A hit counts if it is forward, starts within 10 bases and leaves at most 10
    clipped on the right; the last one in file order gives the length.
    """
    good = hits.filter((~F.col("reverse")) & (F.col("ref_start") <= 10) & (F.col("right_clip") <= 10))
    return good.groupBy(te).agg(F.max_by(F.col("ref_end"), F.col(ordinal)).alias("ltr_len"))
