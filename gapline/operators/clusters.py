"""Clusters of segments, and their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 20


def cluster_by_gap(
    df: DataFrame, *, group: str = "tid", pos: str = "ref_pos", gap: int = 50, ties: Sequence[str] = (), tile: int = TILE, index: str = "cluster_idx"
) -> DataFrame:
    """Single linkage on a line: a new cluster starts where a position is more than ``gap`` behind the one before.

    Clusters are numbered from 0 within each group.  Rows are sorted only within
    tiles of ``tile`` positions; a table with one row for each tile tells where a
    cluster goes on across a border and how many clusters stand before.  Both come
    from one shuffle of the rows, so long as both need all columns: the table takes a
    hash of them along.
    """
    tiled = df.withColumn("__tile", F.floor(F.col(pos) / tile))
    rows = Window.partitionBy(group, "__tile").orderBy(pos, *ties)
    before = F.lag(pos).over(rows)
    broken = F.when(before.isNull() | (F.col(pos) > before + gap), 1).otherwise(0)
    marked = tiled.withColumn("__new", broken)
    local = marked.withColumn("__local", F.sum("__new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    tiles = marked.groupBy(group, "__tile").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.sum("__new").alias("n"), F.max(F.xxhash64(*df.columns)).alias("all"))
    tiles = tiles.filter("all is not null")
    order = Window.partitionBy(group).orderBy("__tile")
    goes_on = F.coalesce((F.col("lo") <= F.lag("hi").over(order) + gap).cast("int"), F.lit(0))
    counted = tiles.withColumn("on", goes_on).withColumn("fresh", F.col("n") - F.col("on"))
    offset = F.coalesce(F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("on")
    offsets = counted.select(F.col(group).alias("__g"), F.col("__tile").alias("__t"), offset.alias("__before"))
    joined = local.join(offsets, (F.col(group) == F.col("__g")) & (F.col("__tile") == F.col("__t")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__local") - 1).cast("bigint").alias(index))


def cluster_bounds(df: DataFrame, *, group: str = "tid", index: str = "cluster_idx", pos: str = "ref_pos") -> DataFrame:
    """(group, index, ref_start, ref_end, num_seg): one base before the first position to the last."""
    return df.groupBy(group, index).agg(
        (F.min(pos) - 1).alias("ref_start"), F.max(pos).alias("ref_end"), F.count(F.lit(1)).alias("num_seg")
    )


def cluster_type(count: Column, reads: Column) -> Column:
    """1 for a single segment, 2 for two of one read, else 0."""
    return F.when(count == 1, 1).when((count == 2) & (reads == 1), 2).otherwise(0)


def entropy(*counts: Column) -> Column:
    """Base-2 entropy of counts."""
    total = sum(counts[1:], counts[0])
    part = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0))
    return sum((part(c) for c in counts[1:]), part(counts[0]))


def balance(left: Column, right: Column) -> Column:
    return (F.least(left, right) + 0.01) / (F.greatest(left, right) + 0.01)


LOCATIONS = (1, 2, 4, 8, 16)


def cluster_features(segments: DataFrame, background: DataFrame, *, key: Sequence[str] = ("tid", "cluster_idx"), min_fraction: float = 0.8, low_mapq: int = 5) -> DataFrame:
    """The feature vector of each cluster of anchored segments.

    ``segments`` has seg_type, aln_type, mapq, aln_location, qname, and the hits'
    sums n_hits, sum_map, sum_score, sum_divergence, query_len; ``background`` is
    the one row of ``background_stats``.  Clusters below ``min_fraction`` keep their
    counts and have zero features.  A segment without hits counts with the
    background's divergence.
    """
    hit, n = F.col("n_hits") > 0, F.count(F.lit(1))
    mean = lambda c, none=0.0: F.avg(F.when(hit, c).otherwise(F.lit(none) if isinstance(none, float) else none))
    bg = F.broadcast(background.select("bg_div", "bg_depth", "bg_read_len").limit(1))
    rows = segments.crossJoin(bg)
    kinds = {k: F.count_if(F.col("seg_type") == v) for k, v in (("num_left", 1), ("num_middle", 2), ("num_right", 4))}
    made = rows.groupBy(*key, "bg_div", "bg_depth", "bg_read_len").agg(
        n.alias("num_seg_raw"),
        F.countDistinct("qname").alias("num_reads"),
        F.avg(hit.cast("int")).alias("aligned_frac"),
        *[c.alias(k) for k, c in kinds.items()],
        F.bit_count(F.bit_or("seg_type")).alias("num_seg_type"),
        F.avg((F.col("mapq") < low_mapq).cast("int")).alias("low_mapq_frac"),
        F.avg((F.col("aln_type") == 5).cast("int")).alias("dual_clip_frac"),
        *[F.avg((F.col("aln_location") == k).cast("int")).alias(f"aln_frac_{k}") for k in LOCATIONS],
        F.avg("mapq").alias("mean_mapq"),
        mean(F.col("sum_score") / F.col("n_hits")).alias("mean_score"),
        mean(F.col("sum_map") / F.col("query_len")).alias("mean_query_frac"),
        mean(F.col("sum_divergence") / F.col("n_hits"), F.col("bg_div")).alias("mean_divergence"),
    )
    passed = F.col("aligned_frac") >= min_fraction
    gate = lambda c: F.when(passed, c).otherwise(F.lit(0.0))
    counts = [F.col(k) for k in kinds]
    gated = ["low_mapq_frac", "dual_clip_frac", *(f"aln_frac_{k}" for k in LOCATIONS), "mean_mapq", "mean_score", "mean_query_frac"]
    return made.withColumns(
        {
            "clt_type": cluster_type(F.col("num_seg_raw"), F.col("num_reads")),
            "entropy": gate(entropy(*counts)),
            "balance_ratio": gate(balance(F.col("num_left"), F.col("num_right"))),
            "mean_divergence": gate(F.try_divide("mean_divergence", "bg_div")),
            "num_seg_norm": gate(F.try_divide(F.col("num_seg_raw"), F.col("bg_depth"))),
            **{k: gate(F.col(k)) for k in gated},
        }
    )


def background_stats(alignments: DataFrame, chromosomes: DataFrame, *, tid: str = "tid", length: str = "length") -> DataFrame:
    """bg_div, bg_depth, bg_read_len and num_chrom, measured on the longest chromosome (the first on ties).

    ``alignments`` has divergence, map_len and read_len of valid alignments.
    """
    longest = chromosomes.agg(
        F.max(F.struct(F.col(length).alias("l"), F.bitwise_not(tid).alias("k"))).alias("best"), F.count(F.lit(1)).alias("num_chrom")
    ).select(F.bitwise_not("best.k").alias("__tid"), F.col("best.l").alias("__length"), "num_chrom")
    on = alignments.join(F.broadcast(longest), F.col(tid) == F.col("__tid"))
    return on.agg(
        F.avg("divergence").alias("bg_div"),
        (F.sum("map_len") / F.first("__length")).alias("bg_depth"),
        F.median("read_len").alias("bg_read_len"),
        F.first("num_chrom").alias("num_chrom"),
    )


def breakpoint_mode(df: DataFrame, *, key: Sequence[str], pos: str = "ref_pos") -> DataFrame:
    """The most frequent position of each cluster, the smallest on ties, and its count."""
    counts = df.groupBy(*key, pos).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(pos)).alias("p")))
    return counts.groupBy(*key).agg(best.alias("best")).select(*key, (-F.col("best.p")).alias("break_pos"), F.col("best.n").alias("n_at_break"))


def representative(df: DataFrame, *, key: Sequence[str], order: Sequence[str], kind: str = "seg_type", read_len: str = "read_len", length: Column | None = None) -> DataFrame:
    """One segment of each cluster: the insert on the longest read, else the longest clip; the first in ``order`` on ties."""
    own = length if length is not None else F.col("query_end") - F.col("query_start")
    insert = F.col(kind) == 2
    rank = F.row_number().over(
        Window.partitionBy(*key).orderBy(insert.desc(), F.when(insert, F.col(read_len)).otherwise(own).desc(), *order)
    )
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def low_quality(blacklisted: Column, probability: Column) -> Column:
    return blacklisted | (probability <= 0.5)


def model_gate(clt_type: Column, fraction: Column, blacklisted: Column, *, high: bool, min_fraction: float = 0.8) -> Column:
    """Whether the model for frequent (``high``) or rare insertions scores a cluster."""
    kind = clt_type == 0 if high else clt_type > 0
    return kind & (fraction >= min_fraction) & ~blacklisted


def vote(same: Column, opposite: Column) -> Column:
    """1 if more votes are for the same strand, 2 for the opposite one, null on a tie."""
    return F.when(same > opposite, 1).when(same < opposite, 2)


def majority(df: DataFrame, *, key: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest on ties."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(value)).alias("v")))
    return counts.groupBy(*key).agg(best.alias("best")).select(*key, (-F.col("best.v")).alias(value), F.col("best.n").alias("n"))
