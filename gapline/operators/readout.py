"""Which reads of clusters go to assembly, and which stand in for one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions.sequences import subsequence
from gapline.operators.clusters import representative
from gapline.operators.segments import trim_region


def segment_sequences(segments: DataFrame, *, name: str = "seg_id", seq: str = "seq") -> DataFrame:
    """(name, seq) of every segment."""
    return segments.select(F.col(name).alias("name"), subsequence(F.col(seq), F.col("query_start"), F.col("query_end")).alias("seq"))


def cluster_reads(segments: DataFrame, clusters: DataFrame, *, key: Sequence[str] = ("tid", "cluster_idx"), flank: int = 3000) -> DataFrame:
    """Reads of frequent clusters of good quality, cut to ``flank`` bases around the segment.

    ``clusters`` has high_quality and clt_type; ``segments`` the read's seq and read_len.
    """
    good = clusters.filter(F.col("high_quality") & (F.col("clt_type") == 0)).select(*key)
    region = trim_region(F.col("query_start"), F.col("query_end"), F.col("read_len"), flank)
    rows = segments.join(good, list(key), "left_semi")
    return rows.select(*key, "qname", subsequence(F.col("seq"), region["start"], region["end"]).alias("seq"))


def stand_ins(segments: DataFrame, clusters: DataFrame, assembled: DataFrame, *, key: Sequence[str] = ("tid", "cluster_idx"), order: Sequence[str] = ("ref_pos", "aln_id", "seg_type"), least: int = 1) -> DataFrame:
    """The representative read of good clusters without an assembly; of at least ``least`` segments."""
    open_ = clusters.filter(F.col("high_quality") & (F.col("num_seg_raw") >= least)).select(*key).join(assembled.select(*key).distinct(), list(key), "left_anti")
    rows = representative(segments.join(open_, list(key), "left_semi"), key=list(key), order=list(order))
    return rows.select(*key, "qname", "seq")


def report(clusters: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: the numbers of clusters, of good ones and of segments."""
    a = clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if("high_quality").alias("n_good"))
    return a.crossJoin(segments.agg(F.count(F.lit(1)).alias("n_segments")))
