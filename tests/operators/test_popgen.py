from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import popgen


def sample(**n):
    return tuple(n.get(k, 0) for k in popgen.FIELDS)


def sites(spark, *samples):
    df = spark.createDataFrame([(1, list(s)) for s in samples], f"pos int, samples array<{popgen.SAMPLE}>")
    return df


def value(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_fisher_equals_enumeration():
    assert popgen.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert popgen.fisher_p(8, 2, 1, 5) == pytest.approx(0.03496503497)
    assert popgen.fisher_p(0, 0, 0, 0) == 1.0
    rng = random.Random(1)
    for _ in range(50):
        a, b, c, d = (rng.randint(0, 9) for _ in range(4))
        row, col, n = a + b, a + c, a + b + c + d
        p = lambda x: math.comb(col, x) * math.comb(n - col, row - x) / math.comb(n, row)  # noqa: B023, E731
        space = range(max(0, row + col - n), min(row, col) + 1)
        assert popgen.fisher_p(a, b, c, d) == pytest.approx(sum(p(x) for x in space if p(x) <= p(a) * (1 + 1e-7)))


def test_chi_square():
    assert popgen.goodness_p(60, 40) == pytest.approx(0.04550026, rel=1e-5)
    assert popgen.contingency_p(9, 19, 29, 39) == pytest.approx(math.erfc(math.sqrt(0.446428571 / 2)), rel=1e-6)
    assert popgen.significance(0.0) == 100.0
    assert popgen.significance(0.01) == pytest.approx(2.0)


def test_fst_and_bias(spark):
    same, other = sample(Af=5, Ar=5, Tf=5, Tr=5), sample(Af=20)
    df = sites(spark, (same, same), (sample(Af=10), sample(Tf=10)), (other, other), (sample(), sample()))
    assert value(df, popgen.fst(F.col("samples"))) == [0.0, 1.0, 0.0, 0.0]
    assert value(df, popgen.max_bias(F.col("samples"))) == [0.0, 0.5, 0.5, 0.0]
    assert value(df, popgen.covered(F.col("samples"), 10)) == [True, True, True, False]
    assert value(df, popgen.unbiased(F.col("samples"), 0.4)) == [True, False, False, True]


def test_ties_among_alleles_go_by_letter(spark):
    df = sites(spark, (sample(Tf=3, Af=3, Gf=1),))
    assert [x.base for x in value(df, popgen.ranked_alleles(popgen.pooled(F.col("samples"))))[0]] == ["A", "T", "G", "C"]


def test_multimeasure(spark):
    df = spark.createDataFrame(
        [("c", 101, [sample(Af=8, Ar=2, Tf=1, Tr=5), sample(Af=10, Tf=10)])], f"chrom string, pos int, samples array<{popgen.SAMPLE}>"
    )
    row = popgen.multimeasure(df, bias="alleleimbalance", measure="fet").first()
    assert row.is_snp and row.measure == pytest.approx(popgen.significance(popgen.fisher_p(10, 6, 10, 10)))
    assert row.strand_bias == pytest.approx(popgen.significance(popgen.fisher_p(18, 2, 11, 5)))
    assert popgen.multimeasure(df, bias="maxsignificance").first().strand_bias == pytest.approx(popgen.significance(popgen.goodness_p(20, 0)))
    with pytest.raises(ValueError):
        popgen.multimeasure(df, bias="none")


def test_global_rank(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 20)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r.k: r["rank"] for r in popgen.ranked(df, order=[F.col("v").desc(), F.col("k")], groups=7).collect()}
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert got == want


def test_global_rank_of_more_rows_than_spark_samples(spark):
    """The bounds of ranges come from a sample here; every rank appears once all the same."""
    n = 300_000
    df = spark.range(0, n, 1, 8).select("id", (F.xxhash64("id") / 7).alias("v"), (F.col("id") % 3).alias("w"))
    made = popgen.ranked(df, order=[F.col("v").desc(), F.col("id").asc()])
    sums = made.agg(F.count(F.lit(1)), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(sums) == (n, n, 1, n)


def test_picked_ranks_are_those_of_a_sort(spark):
    n = 200_000
    df = spark.range(0, n, 1, 8).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 8).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 5 == 1).alias("t"))
    got = popgen.pick_ranks(df, (1, 100), (0.05, 0.5), value="v", order=[F.col("v").desc(), F.col("id").asc()], truth="t").collect()
    want = set()
    for kind in (True, False, None):
        rows = sorted((r.v for r in df.filter(F.col("t").eqNullSafe(F.lit(kind).cast("boolean"))).collect()), reverse=True)
        want |= {(kind, r, rows[r - 1]) for r in (1, 100, int(len(rows) * 0.05), int(len(rows) * 0.5))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
