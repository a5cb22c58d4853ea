"""The whole annotation on one insertion of known parts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gapline.functions import flags as B
from gapline.plans.annotation import annotate_insertions
from gapline.sources import bam


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


HITS = "cluster_id int, tid int, is_left boolean, reverse boolean, valid boolean, ordinal int, start int, end int, first_clip int, last_clip int"


def run(spark, flanks, extended=None):
    contig = "G" * 100 + "C" * 30 + "ACGGT" * 120 + "A" * 30 + "T" * 100
    clusters = table(
        spark,
        "cluster_id int, tid int, cluster_idx int, chrom string, ref_start int, ref_end int, local_start int, local_seq string, flag int, clt_type int, rep_tid int, prob double, n_support int, n_left int, n_span int, n_right int",
        (1, 0, 7, "chr1", 1500, 1503, 1000, "ACGT" * 260, B.ASSEMBLED, 0, 9, 0.75, 4, 1, 2, 1),
        (2, 0, 8, "chr1", 1500, 1503, 1000, "ACGT" * 260, B.ASSEMBLED, 0, 9, 0.75, 4, 1, 2, 1),
    )
    contigs = table(spark, "cluster_id int, tid int, seq string", (1, 0, contig), (2, 0, contig))
    te = table(spark, "cluster_id int, tid int, start int, end int, reverse boolean, ref_start int, ref_end int", (1, 3, 30, 630, False, 0, 600))
    elements = table(spark, "tid int, te_name string, te_len int, ltr_len int, class string", (3, "L1", 600, 0, "LINE"))
    tsd = table(spark, HITS, (1, 0, True, False, True, 0, 0, 508, 0, 3), (1, 0, False, False, True, 1, 498, 900, 4, 0))
    return annotate_insertions(clusters, contigs, table(spark, HITS, *flanks), te, elements, tsd, extended).collect()


def test_both_flanks_on_one_contig(spark):
    (row,) = run(spark, [(1, 0, True, False, True, 0, 0, 100, 0, 2), (1, 0, False, False, True, 1, 760, 860, 3, 0)])
    assert (row.id, row.strand, row["class"], row.assembled) == ("0-7", "+", "L1", 1)
    assert row.ins_seq == "C" * 30 + "ACGGT" * 120 + "A" * 30
    assert (row.start, row.end, row.tsd) == (1498, 1508, ("ACGT" * 260)[498:508])
    assert row.up_seq == "G" * 100 and row.down_seq == "T" * 100
    assert row.regions.startswith("+:30-630") and row.sources.startswith("L1:0-600,PolyA")
    for bit in (B.PASS, B.SAME_CONTIG, B.MAPPED, B.SINGLE, B.TSD, B.FULL_5, B.FULL_3, B.LINE, B.POLY_A, B.NEAR_LEFT, B.NEAR_RIGHT):
        assert row.flag & bit


def test_one_flank_and_one_found_again(spark):
    left = [(1, 0, True, False, True, 0, 0, 100, 0, 2)]
    (row,) = run(spark, left)
    assert row.flag & B.LEFT_FLANK and row.down_seq == "." and row.ins_seq.endswith("T" * 100 + "N" * 50)
    again = table(spark, "cluster_id int, left_most int, right_most int", (1, 100, 760))
    (row,) = run(spark, left, again)
    assert row.flag & B.SAME_CONTIG and not row.flag & B.LEFT_FLANK
    assert row.ins_seq == "C" * 30 + "ACGGT" * 120 + "A" * 30 and row.down_seq == "T" * 100


def test_bam_files_of_one_chromosome_and_long_records(spark, tmp_path):
    rows = [(k % 2, f"r{k:03d}", 0, 10 * k, 60, "100M5I", "ACGTN" * 21, k) for k in range(50)] + [(1, "long", 16, 3, 9, "200000M", "AC" * 100_000, None)]
    df = spark.createDataFrame(rows, "tid int, qname string, flag int, pos int, mapq int, cigar string, seq string, nm int")
    path = f"file://{tmp_path}/out"
    bam.write_bam(df, [("a", 10**6), ("b", 10**6)], path)
    got = bam.read_chromosome(spark, path, 1).select(*df.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if r[0] == 1), key=str)
    for file in tmp_path.glob("out/tid=0/part-*"):
        found = list(bam.decode_records(file.read_bytes()))
        assert [r[4] for r in found] == sorted(r[4] for r in found) and {r[1] for r in found} == {"a"}


def test_the_plan_does_not_repeat_its_steps(spark):
    """Each reader of a step would bring all the steps behind it along."""
    from gapline.plans.stages import annotated_insertions

    made = annotated_insertions(spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().analyzed().toString().count("Join ") < 10


def test_sequences_are_not_broadcast(spark):
    """Spark takes 20 bytes for a text, so it would broadcast contigs of any length."""
    from gapline.plans.annotation import place_flanks
    from gapline.plans.stages import annotated_insertions

    ids = spark.range(50).withColumnRenamed("id", "cluster_id")
    contigs = ids.selectExpr("cluster_id", "CAST(cluster_id % 7 AS INT) AS tid", "repeat('ACGT', 1000) AS seq")
    flanks = ids.selectExpr("cluster_id", "CAST(cluster_id % 7 AS INT) AS tid", "cluster_id % 2 = 0 AS is_left", "false AS reverse", "true AS valid", "0 AS ordinal", "0 AS start", "9 AS end", "0 AS first_clip", "0 AS last_clip")
    placed = place_flanks(ids.withColumn("flag", F.lit(0)), contigs, flanks)
    made = annotated_insertions(spark, "/root/testdata/sf0.001")
    for df, key in ((placed, "cluster_id#\\d+L?, tid1#"), (placed, "cluster_id#\\d+L?, tid2#"), (made, "id#")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"SortMergeJoin \[{key}", plan) and not re.search(rf"BroadcastHashJoin \[{key}", plan)
