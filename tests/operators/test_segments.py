from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gapline.functions import cigar as C
from gapline.operators.segments import extract_segments


def walk(cigar, pos, least):
    import re

    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    q, r, m, out = 0, pos, 0, []
    for i, (n, o) in enumerate(ops):
        if o in "M=X":
            q, r, m = q + n, r + n, m + n
        elif o in "SI":
            if n >= least:
                out.append((1 if i == 0 else 4 if i == len(ops) - 1 else 2, q, q + n, r, m))
            q += n
        elif o in "DN":
            r += n
    return [(k, a, b, p, m if k == 1 else min(x, m - x) if k == 2 else x) for k, a, b, p, x in out]


def test_walk_over_random_cigars(spark):
    rng = random.Random(1)
    rows = [(k, 0, rng.randint(0, 50), "".join(f"{rng.randint(1, 200)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 8)))) for k in range(150)]
    df = spark.createDataFrame(rows, "aln_id int, flag int, pos int, cigar string")
    got = {}
    for r in extract_segments(df).orderBy("aln_id", "seg_order").collect():
        got.setdefault(r.aln_id, []).append((r.seg_type, r.query_start, r.query_end, r.ref_pos, r.overhang))
    assert got == {k: s for k, _, p, c in rows if (s := walk(c, p, 100))}


@pytest.mark.parametrize(("cigar", "n"), [("99S500M", 0), ("100S500M", 1), ("10H100S500M", 1), ("200S199M", 1)])
def test_edges(spark, cigar, n):
    df = spark.createDataFrame([(1, 0, 10, cigar), (2, 256, 10, cigar), (3, 4, 10, cigar)], "aln_id int, flag int, pos int, cigar string")
    rows = extract_segments(df).collect()
    assert len(rows) == n
    if cigar.startswith("10H"):  # a clip behind a hard clip counts as an insert
        assert rows[0].seg_type == 2
    if cigar == "200S199M":
        assert extract_segments(df, min_overhang=200).count() == 0


def test_pairs_and_ends(spark):
    df = spark.createDataFrame([(5, "2S3M1I2D1M")], "pos int, cigar string")
    ops = C.parse(F.col("cigar"))
    row = df.select(C.aligned_pairs(ops, F.col("pos")).alias("p"), C.reference_end(ops, F.col("pos")).alias("e"), C.clip(ops).alias("c"), C.clip(ops, True).alias("d")).first()
    assert [tuple(x) for x in row.p] == [(0, -1), (1, -1), (2, 5), (3, 6), (4, 7), (5, -1), (-1, 8), (-1, 9), (6, 10)]
    assert (row.e, row.c, row.d) == (11, 2, 0)
