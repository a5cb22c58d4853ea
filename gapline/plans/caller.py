"""The insertion caller as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.config import DEFAULT, Config
from gapline.operators import clusters, intervals, segments, te_hits


def find_segments(alignments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Anchored segments with seg_id, a key of alignment and place in it."""
    rows = segments.extract_segments(alignments, min_length=config.min_segment, min_overhang=config.min_overhang)
    return rows.withColumn("seg_id", F.concat_ws(":", "aln_id", "seg_order"))


def locate(alignments: DataFrame, repeats: DataFrame, gaps: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """aln_location of every alignment: its ends against repeats and gaps, which are measured together.

    Both ends are points of one join, so the intervals are read once.
    """
    known = repeats.select("tid", "i_start", "i_end").unionByName(gaps.select("tid", "i_start", "i_end"))
    parsed = segments.with_spans(alignments.select("aln_id", "tid", "pos", "cigar"))
    ends = parsed.select("aln_id", "tid", F.posexplode(F.array("pos", "aln_end")).alias("side", "at"))
    flank = config.location_flank
    met = intervals.overlap_join(
        ends, known, chrom="tid", left_start=F.greatest(F.lit(0), F.col("at") - flank), left_end=F.col("at") + flank,
        right_start="i_start", right_end="i_end", how="left", bin=config.bin,
    )
    near = F.least(F.abs(F.col("at") - F.col("i_start")), F.abs(F.col("at") - F.col("i_end")))
    kinds = []
    for side in (0, 1):
        own = (F.col("side") == side) & F.col("i_start").isNotNull()
        kinds += [F.count_if(own).alias(f"n{side}"), F.min(F.when(own, near)).alias(f"d{side}")]
    # one aggregation by alignment, whatever the number of its ends and bins
    both = met.groupBy("aln_id").agg(*kinds)
    a, b = (intervals.location_type(F.col(f"n{side}"), F.col(f"d{side}"), config.edge_distance) for side in (0, 1))
    return both.select("aln_id", intervals.alignment_location(a, b).alias("aln_location"))


def find_clusters(segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return clusters.cluster_by_gap(segments, group="tid", pos="ref_pos", gap=config.max_gap, ties=("aln_id", "seg_type"), tile=config.tile)


def call(
    alignments: DataFrame, hits: DataFrame, repeats: DataFrame, gaps: DataFrame, blacklist: DataFrame, background: DataFrame, scorer, config: Config = DEFAULT
) -> DataFrame:
    """Clusters with features, blacklist mark, probability and quality.

    ``hits`` come from an aligner (see ``ext``) and name their segment by seg_id;
    ``scorer`` maps the feature columns to a probability column.
    """
    found = find_segments(alignments, config).join(locate(alignments, repeats, gaps, config), "aln_id")
    found = te_hits.attach_hits(found, te_hits.merge_hits(hits, ties=("hit_id",)))
    found = found.withColumn("query_len", F.col("query_end") - F.col("query_start"))
    grouped = find_clusters(found, config)
    features = clusters.cluster_features(grouped, background, min_fraction=config.aligned_fraction, low_mapq=config.low_mapq)
    bounds = clusters.cluster_bounds(grouped).drop("num_seg")
    made = features.join(bounds, ["tid", "cluster_idx"])
    marked = intervals.interval_flank_join(
        made, blacklist, key=["tid", "cluster_idx"], chrom="tid", q_start="ref_start", q_end="ref_end", start="i_start", end="i_end",
        flank=config.blacklist_flank, bin=config.bin,
    )
    rows = marked.withColumn("in_blacklist", F.col("n_overlap") > 0).drop("n_overlap", "min_distance", "rep_id")
    gate = (F.col("aligned_frac") >= config.aligned_fraction) & ~F.col("in_blacklist")
    rows = rows.withColumn("probability", F.when(gate, scorer(rows)).otherwise(0.0))
    low = clusters.low_quality(F.col("in_blacklist"), F.col("probability"))
    return rows.withColumn("high_quality", ~low)
