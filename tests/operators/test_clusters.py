from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import clusters, intervals, te_hits


def scan_clusters(rows, gap):
    out, last, index = {}, {}, {}
    for g, p, k in sorted(rows):
        if g not in last or p > last[g] + gap:
            index[g] = index.get(g, -1) + 1
        last[g] = p
        out[k] = index[g]
    return out


@pytest.mark.parametrize("tile", [1, 7, 64, 1 << 20])
def test_cluster_by_gap_equals_a_scan(spark, tile):
    rng = random.Random(tile)
    rows = [(rng.randint(0, 2), rng.choice([rng.randint(0, 400), rng.randint(0, 40)]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "tid int, ref_pos int, k int")
    got = {r.k: r.cluster_idx for r in clusters.cluster_by_gap(df, gap=5, ties=("k",), tile=tile).collect()}
    assert got == scan_clusters(rows, 5)


def test_gap_of_50_joins_and_51_parts(spark):
    df = spark.createDataFrame([(0, 100, 0), (0, 150, 1), (0, 201, 2)], "tid int, ref_pos int, k int")
    rows = clusters.cluster_by_gap(df).collect()
    assert [r.cluster_idx for r in sorted(rows, key=lambda r: r.k)] == [0, 0, 1]
    bounds = clusters.cluster_bounds(clusters.cluster_by_gap(df)).orderBy("cluster_idx").collect()
    assert [tuple(r) for r in bounds] == [(0, 0, 99, 150, 2), (0, 1, 200, 201, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "tid int, ref_pos int, k int")
    assert clusters.cluster_by_gap(df).count() == 0


@pytest.mark.parametrize("bin", [3, 50, 1 << 14])
def test_interval_joins_equal_a_scan(spark, bin):
    rng = random.Random(bin)
    points = [(k, rng.randint(0, 1), rng.randint(0, 300)) for k in range(60)]
    ivls = [(rng.randint(0, 1), s, s + rng.randint(0, 60), k) for k in range(40) for s in [rng.randint(0, 300)]]
    p = spark.createDataFrame(points, "k int, chrom int, pos int")
    i = spark.createDataFrame(ivls, "chrom int, start int, end int, ident int")
    got = {r.k: (r.n_overlap, r.min_distance) for r in intervals.point_flank_join(p, i, key=["k"], flank=10, bin=bin).collect()}
    for k, c, x in points:
        hits = [(s, e) for cc, s, e, _ in ivls if cc == c and s < x + 10 and e > max(0, x - 10)]
        assert got[k] == (len(hits), min((min(abs(x - s), abs(x - e)) for s, e in hits), default=None))
    q = p.withColumn("stop", F.col("pos") + F.col("k") % 20)
    found = intervals.interval_flank_join(q, i, key=["k"], q_start="pos", q_end="stop", ident="ident", flank=10, bin=bin).collect()
    for r in found:
        x, y = r.pos, r.stop
        hits = [(s, e, n) for cc, s, e, n in ivls if cc == r.chrom and s < y + 10 and e > max(0, x - 10)]
        edges = min((min(abs(a - b) for a in (x, y) for b in (s, e)) for s, e, _ in hits), default=None)
        assert (r.n_overlap, r.min_distance, r.rep_id) == (len(hits), edges, min(hits)[2] if hits else None)
    semi = intervals.overlapping(q, i, q_start="pos", q_end="stop", key=["k"], bin=bin)
    anti = intervals.overlapping(q, i, q_start="pos", q_end="stop", key=["k"], anti=True, bin=bin)
    assert semi.count() + anti.count() == len(points)


def test_location_types(spark):
    df = spark.createDataFrame([(0, None), (1, 49), (1, 50)], "n int, d int")
    assert [r[0] for r in df.select(intervals.location_type(F.col("n"), F.col("d"))).collect()] == [1, 2, 4]
    df = spark.createDataFrame([(1, 1), (1, 4), (4, 4), (2, 2), (1, 2), (2, 4)], "a int, b int")
    assert [r[0] for r in df.select(intervals.alignment_location(F.col("a"), F.col("b"))).collect()] == [1, 1, 2, 4, 8, 16]


def test_hit_union_equals_sets(spark):
    rng = random.Random(3)
    rows = [(k % 20, k, s, s + rng.randint(1, 50), 1.0, 2, 4) for k in range(200) for s in [rng.randint(0, 200)]]
    df = spark.createDataFrame(rows, "seg_id int, hit int, query_start int, query_end int, divergence double, score int, map_len int")
    got = {r.seg_id: r.sum_map for r in te_hits.merge_hits(df, ties=("hit",)).collect()}
    for seg in range(20):
        assert got[seg] == len({x for s, _, a, b, *_ in rows if s == seg for x in range(a, b)})


def test_representative_may_be_the_first_insert(spark):
    rows = [(0, 2, 0, 100, 900, 0), (0, 1, 0, 5000, 9000, 1), (1, 1, 0, 10, 50, 2), (1, 4, 0, 20, 40, 3), (1, 4, 0, 20, 60, 4)]
    df = spark.createDataFrame(rows, "c int, seg_type int, query_start int, query_end int, read_len int, k int")
    got = {r.c: r.k for r in clusters.representative(df, key=["c"], order=["k"]).collect()}
    assert got == {0: 0, 1: 3}
