from __future__ import annotations

import random

from pyspark.sql import functions as F

from gapline.functions import flags as B
from gapline.functions import sequences
from gapline.operators import annotate, consensus, filters


def scan_tails(seq, tail_a):
    """A loop over the bases, as the definition reads."""
    target, other = ("A", "T") if tail_a else ("T", "A")
    n, out = len(seq), []
    order = range(n) if tail_a else range(n - 1, -1, -1)
    size = total = misses = best = top = 0
    at = 0

    def close():
        if best >= 5 and (n - best + 1) * 0.25**best <= 0.01:
            out.append((at + 1 - best, at + 1) if tail_a else (at, at + best))

    for i in order:
        size += 1
        if seq[i].upper() == target:
            total += 1
        else:
            total -= 1 if seq[i].upper() == other else 3
            misses += 1
        if total > top:
            best, top, at = size, total, i
        if total < 0 or misses > 10:
            close()
            size = total = misses = best = top = 0
    close()
    return out


def test_tails_equal_a_loop(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("AAAATCGn") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    seqs += ["A" * 20, "A" * 21, "N" * 30, "", "T" * 20, "AAAAA", "CCCCCAAAAAAAAAACCCC"]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    rows = df.select("k", sequences.poly_tails(F.col("s"), True).alias("a"), sequences.poly_tails(F.col("s"), False).alias("t")).collect()
    for r in rows:
        assert [tuple(x) for x in r.a] == scan_tails(seqs[r.k], True)
        assert [tuple(x) for x in r.t] == scan_tails(seqs[r.k], False)


def test_flank_tails(spark):
    seqs = ["T" * 20, "C" * 20, "T" * 19, "T" * 15 + "CCCCC", "C" * 8 + "T" * 6 + "C" * 6, "AAAAAA" + "C" * 14, "A" * 20, None]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, s string")
    rows = df.select("k", sequences.flank_has_tail(F.col("s"), False).alias("t"), sequences.flank_has_tail(F.col("s"), True).alias("a")).orderBy("k").collect()
    assert [r.t for r in rows] == [True, False, False, True, False, False, False, False]
    assert [r.a for r in rows] == [False, False, False, False, False, True, False, False]


def annotations(spark, rows):
    return spark.createDataFrame(
        rows,
        "cluster_id int, tid int, query_start int, query_end int, reverse boolean, ref_start int, ref_end int, flag int, te_len int, ltr_len int, te_class int",
    )


def structure(spark, rows, flag=B.SAME_CONTIG | B.MAPPED, ins_len=1000, left="C" * 20, right="C" * 20):
    clusters = spark.createDataFrame([(1, flag, ins_len, left, right)], "cluster_id int, flag int, ins_len int, left_seq string, right_seq string")
    return annotate.structure(annotations(spark, rows), clusters).first().flag


def test_full_line_with_tail(spark):
    both = B.LINE | B.FULL_5 | B.FULL_3
    rows = [(1, 3, 10, 950, False, 0, 940, both, 940, 0, B.LINE), (1, -1, 955, 990, False, 0, 0, 0, None, None, None)]
    got = structure(spark, rows)
    for bit in (B.NEAR_LEFT, B.NEAR_RIGHT, B.POLY_A, B.FULL_5, B.FULL_3, B.LINE):
        assert got & bit
    assert not got & (B.AT_RICH | B.UNKNOWN_5 | B.UNKNOWN_3)


def test_tail_too_far_and_reverse_strand(spark):
    both = B.LINE | B.FULL_3
    far = [(1, 3, 10, 900, False, 0, 940, both, 940, 0, B.LINE), (1, -1, 920, 990, False, 0, 0, 0, None, None, None)]
    assert not structure(spark, far) & B.POLY_A
    reverse = [(1, -2, 20, 50, True, 0, 0, 0, None, None, None), (1, 3, 60, 990, True, 0, 940, both, 940, 0, B.LINE)]
    assert structure(spark, reverse) & B.POLY_A


def test_unknown_ends_and_rich_flank(spark):
    rows = [(1, 3, 10, 990, False, 300, 940, B.LINE | B.FULL_3, 940, 0, B.LINE)]
    got = structure(spark, rows, flag=B.RIGHT_FLANK, right="A" * 6 + "C" * 14)
    assert got & B.UNKNOWN_5 and got & B.AT_RICH and not got & B.UNKNOWN_3


def test_solo_ltr(spark):
    rows = [(1, 3, 10, 990, False, 5, 395, B.LTR, 5000, 400, B.LTR)]
    assert structure(spark, rows, flag=B.SAME_CONTIG | B.SINGLE) & B.SOLO_LTR
    rows = [(1, 3, 10, 990, False, 5, 350, B.LTR, 5000, 400, B.LTR)]
    assert not structure(spark, rows, flag=B.SAME_CONTIG | B.SINGLE) & B.SOLO_LTR


def test_cluster_without_annotations_keeps_its_flag(spark):
    clusters = spark.createDataFrame([(2, 4, 10, "A", "A")], "cluster_id int, flag int, ins_len int, left_seq string, right_seq string")
    assert annotate.structure(annotations(spark, []), clusters).first().flag == 4


def test_post_filter_truth_table(spark):
    near, full = B.NEAR_BOTH, B.FULL_BOTH
    cases = [
        (B.LINE | near | B.POLY_A, 0, B.PASS),
        (B.LINE | near | full | B.SINGLE, 0, B.PASS),
        (B.LINE | near | full | B.SINGLE | B.SELF, 0, 0),
        (B.LINE | B.NEAR_LEFT | B.POLY_A, 0, B.POLY_A_ONLY),
        (B.LTR | near | full | B.SELF, 0, 0),
        (B.LTR | near | B.SOLO_LTR | B.SELF | B.TSD, 0, B.PASS),
        (B.DNA | near | full, 0, B.PASS),
        (near | full | B.SELF, 0, 0),
        (B.LINE | near | B.FULL_5 | B.UNKNOWN_3 | B.SINGLE, 1, B.SECONDARY),
        (B.LINE | near | B.UNKNOWN_5 | B.FULL_3 | B.SINGLE, 1, 0),
        (B.DNA | near | B.UNKNOWN_5 | B.FULL_3 | B.SINGLE, 2, B.SECONDARY),
        (B.DNA | near | B.UNKNOWN_5 | B.FULL_3 | B.SINGLE, 0, 0),
    ]
    df = spark.createDataFrame([(k, f, t) for k, (f, t, _) in enumerate(cases)], "k int, flag long, clt_type int")
    for r in df.select("k", "flag", filters.post_filter(F.col("flag"), F.col("clt_type")).alias("new")).collect():
        assert r.new & ~r.flag == cases[r.k][2], r.k


def test_insertion_sequences(spark):
    cases = [(B.LEFT_FLANK, "CCGGTT" + "N" * 50), (B.RIGHT_FLANK, "N" * 50 + "TTT"), (B.SAME_CONTIG, "C"), (B.DIFFERENT_CONTIGS, "CCGGTT" + "N" * 500 + "TTT"), (0, None)]
    df = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(cases)], "k int, flag int")
    made = annotate.insertion_sequence(F.col("flag"), F.lit("AACCGGTT"), F.lit(2), F.lit("TTTAAA"), F.lit(3), pad=True)
    for r in df.select("k", made.alias("s")).collect():
        assert r.s == cases[r.k][1]


def test_tsd_overlap_of_49_and_50(spark):
    df = spark.createDataFrame([(149, 100), (150, 100), (100, 120), (100, None), (None, 100), (None, None)], "l int, r int")
    got = [tuple(r[0]) for r in df.select(annotate.refine_breakpoint(F.col("l"), F.col("r"), F.lit(1000))).collect()]
    assert got == [(1100, 1149, True), (1100, 1150, False), (1100, 1120, False), (1099, 1100, False), (1099, 1100, False), (None, None, False)]


def test_skip_next(spark):
    df = spark.createDataFrame([([True, True, True, False, True],), ([],)], "x array<boolean>")
    got = [r[0] for r in df.select(consensus.skip_next(F.col("x"))).collect()]
    assert got == [[True, False, True, False, True], []]
