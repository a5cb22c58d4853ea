"""Annotation of insertion sequences: flanks, hits, tails, structure, output rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions import flags as B
from gapline.functions.flags import clear, has_all, has_any, set_if
from gapline.functions.sequences import flank_has_tail, poly_tails, subsequence

#: Sequence numbers of tails among the elements' numbers.
TAIL_A, TAIL_T = -1, -2


# --- flanks and insertion sequences -------------------------------------------------


def choose_flanks(hits: DataFrame, *, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """The hit of either flank on the assembly with the least inner clip, the later on ties.

    ``hits`` has is_left, reverse, valid, ordinal, tid, start, end, first_clip, last_clip.
    Result: tid1, left_most, outer1 (the left flank's outer clip), tid2, right_most, outer2.
    """
    good = hits.filter(F.col("valid") & ~F.col("reverse"))
    left = F.col("is_left")
    inner = F.when(left, F.col("last_clip")).otherwise(F.col("first_clip"))
    rank = F.struct(inner.alias("clip"), (-F.col("ordinal")).alias("o"), "tid", "start", "end", "first_clip", "last_clip")
    best = good.groupBy(*key).agg(F.min(F.when(left, rank)).alias("l"), F.min(F.when(~left, rank)).alias("r"))
    return best.select(
        *key,
        F.coalesce("l.tid", F.lit(-1)).alias("tid1"),
        F.coalesce("l.end", F.lit(0)).alias("left_most"),
        F.coalesce("l.first_clip", F.lit(0)).alias("outer1"),
        F.coalesce("r.tid", F.lit(-1)).alias("tid2"),
        F.coalesce("r.start", F.lit(0)).alias("right_most"),
        F.coalesce("r.last_clip", F.lit(0)).alias("outer2"),
    )


def flank_flag(tid1: Column, left_most: Column, outer1: Column, tid2: Column, right_most: Column, outer2: Column, clip: int = 400) -> Column:
    """Which flanks of the assembly map, as flag bits."""
    none1, none2, bad1, bad2 = tid1 < 0, tid2 < 0, outer1 > clip, outer2 > clip
    same = (tid1 == tid2) & (left_most <= right_most - 100)
    return (
        F.when((none1 & none2) | (bad1 & bad2), 0)
        .when(none2 | (~none1 & bad2), B.LEFT_FLANK)
        .when(none1 | bad1, B.RIGHT_FLANK)
        .when(same, B.SAME_CONTIG)
        .when(tid1 != tid2, B.DIFFERENT_CONTIGS)
        .otherwise(0)
    )


def insertion_sequence(flag: Column, seq1: Column, left_most: Column, seq2: Column, right_most: Column, pad: bool = False) -> Column:
    """The inserted bases: behind the left flank, before the right one, or between them.

    Contigs that differ are joined by 500 N; ``pad`` adds 50 N for an unmapped flank.
    """
    behind = subsequence(seq1, left_most, F.char_length(seq1))
    before = subsequence(seq2, 0, right_most)
    gap = F.repeat(F.lit("N"), F.lit(50 if pad else 0))
    return (
        F.when(has_any(flag, B.LEFT_FLANK), F.concat(behind, gap))
        .when(has_any(flag, B.RIGHT_FLANK), F.concat(gap, before))
        .when(has_any(flag, B.SAME_CONTIG), subsequence(seq1, left_most, right_most))
        .when(has_any(flag, B.DIFFERENT_CONTIGS), F.concat(behind, F.repeat(F.lit("N"), F.lit(500)), before))
    )


def can_extend(left_end: Column, right_start: Column, left_outer: Column, right_outer: Column, ref_start: Column, ref_end: Column, local_start: Column, limit: int = 50) -> Column:
    """Whether both assembled flanks fit the reference around the breakpoint."""
    off = lambda p: F.least(F.abs(p + local_start - ref_start), F.abs(p + local_start - ref_end)) <= limit
    return (
        (left_end != 0) & (right_start != 0) & (left_outer <= limit) & (right_outer <= limit)
        & off(left_end) & off(right_start) & (F.abs(right_start - left_end) <= limit)
    )


def both_flanks_flag(flag: Column) -> Column:
    """The flag of a cluster whose missing flank was found on the same contig."""
    return clear(flag, B.LEFT_FLANK | B.RIGHT_FLANK).bitwiseOR(F.lit(B.SAME_CONTIG))


def flank_windows(breakpoint_start: Column, breakpoint_end: Column, length: Column, size: int = 500) -> Column:
    """Reference windows beside a breakpoint, and the local window around it."""
    s, e = breakpoint_start, breakpoint_end
    return F.struct(
        F.greatest(F.lit(0), s - size).alias("left_start"),
        s.alias("left_end"),
        e.alias("right_start"),
        F.least(length, e + size).alias("right_end"),
        F.greatest(F.lit(0), s - size).alias("local_start"),
        F.least(length, e + size).alias("local_end"),
    )


def output_sequences(flag: Column, ref_seq: Column, ref_start: Column, ref_end: Column, seq1: Column, left_most: Column, seq2: Column, right_most: Column) -> Column:
    """(tsd, ins, left, right) of an output row; ``.`` for what is unknown."""
    dot = F.lit(".")
    left = F.when(has_any(flag, B.RIGHT_FLANK), dot).otherwise(subsequence(seq1, left_most - 500, left_most))
    right = F.when(has_any(flag, B.LEFT_FLANK), dot).otherwise(subsequence(seq2, right_most, right_most + 500))
    return F.struct(
        F.when(has_any(flag, B.TSD), subsequence(ref_seq, ref_start, ref_end)).otherwise(dot).alias("tsd"),
        insertion_sequence(flag, seq1, left_most, seq2, right_most, pad=True).alias("ins"),
        left.alias("left"),
        right.alias("right"),
    )


# --- hits of the insertion ----------------------------------------------------------


def hit_flag(ref_start: Column, ref_end: Column, length: Column, class_bit: Column) -> Column:
    """Class of an element and whether a hit reaches its ends: within 8 % of its length, at most 100."""
    margin = F.least(F.floor(length * 0.08), F.lit(100))
    return set_if(set_if(class_bit, ref_start < margin, B.FULL_5), length - ref_end < margin, B.FULL_3)


def cluster_hit_flag(hits: DataFrame, *, key: Sequence[str] = ("cluster_id",), rep: str = "rep_tid") -> DataFrame:
    """MAPPED, SINGLE and SELF of each cluster with hits, and its outermost ends."""
    flag = F.lit(B.MAPPED)
    flag = set_if(flag, F.count(F.lit(1)) == 1, B.SINGLE)
    flag = set_if(flag, F.max((F.col("tid") == F.col(rep)).cast("int")) == 1, B.SELF)
    return hits.groupBy(*key).agg(flag.alias("hit_flag"), F.min("query_start").alias("first_start"), F.max("query_end").alias("last_end"))


def tail_rows(clusters: DataFrame, *, key: Sequence[str] = ("cluster_id",), seq: str = "ins_seq", margin: int = 5) -> DataFrame:
    """A and T tails beside the hits as annotation rows.

    ``clusters`` has first_start and last_end of the hits, and the strand and flag
    of the first and the last one (first_reverse, first_flag, last_reverse, last_flag).
    Only retroelements have tails: A behind a forward last hit, T before a reverse first one.
    """
    length = F.char_length(seq)
    after = subsequence(F.col(seq), F.col("last_end"), length)
    ahead = subsequence(F.col(seq), 0, F.col("first_start"))
    has_a = (length - F.col("last_end") >= margin) & ~F.col("last_reverse") & has_any(F.col("last_flag"), B.RETRO)
    has_t = (F.col("first_start") >= margin) & F.col("first_reverse") & has_any(F.col("first_flag"), B.RETRO)
    row = lambda tid, shift, reverse: lambda t: F.struct(
        F.lit(tid).alias("tid"),
        (t["start"] + shift).alias("query_start"),
        (t["end"] + shift).alias("query_end"),
        F.lit(reverse).alias("reverse"),
        F.lit(0).alias("ref_start"),
        F.lit(0).alias("ref_end"),
        F.lit(0).alias("flag"),
    )
    none = F.array().cast("array<struct<tid:int,query_start:int,query_end:int,reverse:boolean,ref_start:int,ref_end:int,flag:int>>")
    a = F.when(has_a, F.transform(poly_tails(after, True), row(TAIL_A, F.col("last_end"), False))).otherwise(none)
    t = F.when(has_t, F.transform(poly_tails(ahead, False), row(TAIL_T, F.lit(0), True))).otherwise(none)
    return clusters.select(*key, F.explode_outer(F.concat(a, t)).alias("__t")).filter("__t is not null").select(*key, "__t.*")


# --- structure ----------------------------------------------------------------------

PARTS = ("tid", "query_start", "query_end", "reverse", "ref_start", "ref_end", "flag", "te_len", "ltr_len", "te_class")


def structure(annotations: DataFrame, clusters: DataFrame, *, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Clusters with the flag bits that the order of their annotations implies.

    ``annotations`` has the columns of ``PARTS`` (te_len, ltr_len and the class bit
    te_class are null for tails); ``clusters`` has flag, ins_len, left_seq and
    right_seq (the 20 bases beside the insertion).  The first and last element skip
    tails.  Clusters without annotations keep their flag.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("query_start").alias("__s"), F.col("query_end").alias("__e"), F.col("tid").alias("__k"), *PARTS)))
    found = annotations.groupBy(*key).agg(rows.alias("__all"))
    te = F.filter("__all", lambda x: x["tid"] >= 0)
    joined = clusters.join(found, list(key), "left").withColumns(
        {
            "__first": F.try_element_at(F.col("__all"), F.lit(1)),
            "__last": F.try_element_at(F.col("__all"), F.lit(-1)),
            "__left": F.try_element_at(te, F.lit(1)),
            "__right": F.try_element_at(te, F.lit(-1)),
            "__a": F.try_element_at(F.filter("__all", lambda x: x["tid"] == TAIL_A), F.lit(1)),
            "__t": F.try_element_at(F.filter("__all", lambda x: x["tid"] == TAIL_T), F.lit(-1)),
        }
    )
    first, last, left, right = (F.col(f"__{k}") for k in ("first", "last", "left", "right"))
    flag, ins_len = F.col("flag"), F.col("ins_len")

    cutoff = lambda x: F.greatest(F.floor(x["te_len"] * 0.2), F.lit(100))
    flag = set_if(flag, first["query_start"] < cutoff(left), B.NEAR_LEFT)
    flag = set_if(flag, ins_len - last["query_end"] < cutoff(right), B.NEAR_RIGHT)

    many = F.size("__all") > 1
    t_ok = (first["tid"] == TAIL_T) & has_any(left["flag"], B.FULL_3)
    t_ok &= (left["query_start"] - F.col("__t.query_end") < 20) & (first["query_start"] < 100)
    a_ok = (last["tid"] == TAIL_A) & has_any(right["flag"], B.FULL_3)
    a_ok &= (F.col("__a.query_start") - right["query_end"] < 20) & (ins_len - last["query_end"] < 100)
    flag = set_if(flag, many & (t_ok | a_ok), B.POLY_A)

    has5, has3 = (lambda x: has_any(x["flag"], B.FULL_5)), (lambda x: has_any(x["flag"], B.FULL_3))
    flag = set_if(flag, (~left["reverse"] & has5(left)) | (right["reverse"] & has5(right)), B.FULL_5)
    flag = set_if(flag, (left["reverse"] & has3(left)) | (~right["reverse"] & has3(right)), B.FULL_3)
    only_left, only_right = has_any(flag, B.LEFT_FLANK), has_any(flag, B.RIGHT_FLANK)
    no5, no3 = ~has_any(flag, B.FULL_5), ~has_any(flag, B.FULL_3)
    flag = set_if(flag, no5 & ((~left["reverse"] & only_right) | (right["reverse"] & only_left)), B.UNKNOWN_5)
    flag = set_if(flag, no3 & ((left["reverse"] & only_right) | (~right["reverse"] & only_left)), B.UNKNOWN_3)

    span = lambda x: x["ref_end"] - x["ref_start"]
    flag = flag.bitwiseOR(F.coalesce(F.when(span(left) > span(right), left["te_class"]).otherwise(right["te_class"]), F.lit(0)))
    made = joined.withColumn("__flag", flag)

    flag = F.col("__flag")
    retro = lambda x: has_any(x["flag"], B.RETRO)
    both = has_any(flag, B.BOTH_FLANKS)
    t_rich = (has_any(flag, B.LEFT_FLANK) | both) & flank_has_tail(F.col("left_seq"), False) & left["reverse"] & has3(left) & retro(left)
    a_rich = (has_any(flag, B.RIGHT_FLANK) | both) & flank_has_tail(F.col("right_seq"), True) & ~right["reverse"] & has3(right) & retro(right)
    rich = ~has_any(flag, B.POLY_A) & (F.coalesce(t_rich, F.lit(False)) | F.coalesce(a_rich, F.lit(False)))
    flag = set_if(flag, rich, B.AT_RICH)
    ltr, te_len = left["ltr_len"], left["te_len"]
    at_left = (left["ref_start"] <= 20) & (F.abs(left["ref_end"] - ltr) <= 20)
    at_right = (F.abs(left["ref_start"] - (te_len - ltr)) <= 20) & (F.abs(left["ref_end"] - te_len) <= 20)
    flag = set_if(flag, has_all(F.col("__flag"), B.LTR | B.SINGLE) & (ltr > 0) & (at_left | at_right), B.SOLO_LTR)
    return made.select(*[c for c in clusters.columns if c != "flag"], flag.alias("flag"))


def shift_annotations(annotations: DataFrame, amount: Column) -> DataFrame:
    return annotations.withColumns({c: F.col(c) + amount for c in ("query_start", "query_end")})


# --- target-site duplications -------------------------------------------------------


def choose_tsd_hits(hits: DataFrame, *, key: Sequence[str] = ("cluster_id",), limit: int = 50, outer: int = 20) -> DataFrame:
    """left_end and right_start of the accepted hits of the breakpoint windows, null without one.

    A hit is forward, ends within ``limit`` of the breakpoint's middle and leaves at
    most ``outer`` bases clipped away from it; the last accepted one counts.
    """
    left, mid = F.col("is_left"), F.floor((F.col("ref_start") + F.col("ref_end")) / 2)
    place = F.when(left, F.col("end")).otherwise(F.col("start"))
    clip = F.when(left, F.col("first_clip")).otherwise(F.col("last_clip"))
    good = F.col("valid") & ~F.col("reverse") & (F.abs(F.col("local_start") + place - mid) <= limit) & (clip <= outer)
    return hits.groupBy(*key).agg(
        F.max_by(F.when(good & left, F.col("end")), F.when(good & left, F.col("ordinal"))).alias("left_end"),
        F.max_by(F.when(good & ~left, F.col("start")), F.when(good & ~left, F.col("ordinal"))).alias("right_start"),
    )


def refine_breakpoint(left_end: Column, right_start: Column, local_start: Column, limit: int = 50) -> Column:
    """(start, end, tsd) of the refined breakpoint; null start and end if no hit was accepted."""
    both = left_end.isNotNull() & right_start.isNotNull()
    one = local_start + F.coalesce(left_end, right_start)
    return F.struct(
        F.when(both, local_start + F.least(left_end, right_start)).otherwise(one - 1).alias("start"),
        F.when(both, local_start + F.greatest(left_end, right_start)).otherwise(one).alias("end"),
        F.coalesce(both & (right_start < left_end) & (left_end - right_start < limit), F.lit(False)).alias("tsd"),
    )


def legacy_tsd(coords: Column, limit: int = 30) -> Column:
    """The middle two of four coordinates; ``too_long`` if they are more than ``limit`` apart."""
    c = F.array_sort(coords)
    a, b = F.element_at(c, 2), F.element_at(c, 3)
    return F.when(b - a > limit, F.lit("too_long")).otherwise(F.concat_ws("-", a, b))


# --- output rows --------------------------------------------------------------------


def annotation_strings(annotations: DataFrame, *, key: Sequence[str] = ("cluster_id",), name: str = "te_name") -> DataFrame:
    """One row for each cluster: strand, class, regions, sources.

    Parts stand in the order of the insertion.  The class lists the elements in
    the order of their numbers; the strand is that of most hits, ``.`` on a tie.
    """
    te = F.col("tid") >= 0
    sign = F.when(F.col("reverse"), F.lit("-")).otherwise(F.lit("+"))
    region = F.concat(sign, F.lit(":"), F.col("query_start"), F.lit("-"), F.col("query_end"))
    label = F.when(F.col("tid") == TAIL_A, F.lit("PolyA")).when(F.col("tid") == TAIL_T, F.lit("PolyT")).otherwise(F.col(name))
    source = F.concat(label, F.lit(":"), F.col("ref_start"), F.lit("-"), F.col("ref_end"))
    parts = F.array_sort(F.collect_list(F.struct("query_start", "query_end", "tid", region.alias("region"), source.alias("source"))))
    balance = F.sum(F.when(te, F.when(F.col("reverse"), -1).otherwise(1)).otherwise(0))
    made = annotations.groupBy(*key).agg(
        parts.alias("p"), balance.alias("b"), F.array_sort(F.collect_set(F.when(te, F.struct("tid", F.col(name).alias("name"))))).alias("t")
    )
    return made.select(
        *key,
        F.when(F.col("b") > 0, "+").when(F.col("b") < 0, "-").otherwise(".").alias("strand"),
        F.array_join(F.transform("t", lambda x: x["name"]), ",").alias("class"),
        F.array_join(F.transform("p", lambda x: x["region"]), ",").alias("regions"),
        F.array_join(F.transform("p", lambda x: x["source"]), ",").alias("sources"),
    )


#: The order of the columns of the final table.
RESULT = (
    "chrom", "start", "end", "class", "prob", "strand", "id", "regions", "sources", "n_support", "n_left", "n_span", "n_right",
    "assembled", "tsd", "ins_seq", "up_seq", "down_seq", "flag",
)


def final_table(clusters: DataFrame, annotations: DataFrame, *, key: str = "id") -> DataFrame:
    """Clusters joined to their annotation strings, in the output's order of columns."""
    return clusters.join(annotations, key).select(*RESULT)


def neighbour_gaps(annotations: DataFrame, *, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Distances of each annotation to the one before and the one behind."""
    order = Window.partitionBy(*key).orderBy("query_start", "query_end", "tid")
    return annotations.withColumns(
        {
            "gap_before": F.col("query_start") - F.lag("query_end").over(order),
            "gap_behind": F.lead("query_start").over(order) - F.col("query_end"),
        }
    )
