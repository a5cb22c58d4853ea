"""Pooled allele statistics.

A site is (chrom, pos, ref, samples); a sample is a struct of strand-specific
counts: A a T t C c G g (capital letters forward).  Struct fields differ by case
only, so they are stored as Af Ar Tf Tr Cf Cr Gf Gr.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gapline.sources import scratch

BASES = "ATCG"
FIELDS = tuple(f"{b}{s}" for b in BASES for s in "fr")
#: Keys that may be broadcast.
BROADCAST_ROWS = 10_000
SAMPLE = "struct<" + ",".join(f"{k}:bigint" for k in FIELDS) + ">"


# --- samples ------------------------------------------------------------------------


def allele(sample: Column, base: str) -> Column:
    return sample[f"{base}f"] + sample[f"{base}r"]


def coverage(sample: Column) -> Column:
    return sum((sample[k] for k in FIELDS[1:]), sample[FIELDS[0]])


def forward(sample: Column) -> Column:
    return sum((sample[f"{b}f"] for b in BASES[1:]), sample[f"{BASES[0]}f"])


def strand_bias(sample: Column) -> Column:
    """|forward share - 1/2|; 0 without coverage."""
    return F.coalesce(F.abs(F.try_divide(forward(sample), coverage(sample)) - 0.5), F.lit(0.0))


def pooled(samples: Column) -> Column:
    """The sum of the samples, as one."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in FIELDS])
    return F.aggregate(samples, zero, lambda a, s: F.struct(*[(a[k] + s[k]).alias(k) for k in FIELDS]))


def min_coverage(samples: Column) -> Column:
    return F.array_min(F.transform(samples, coverage))


def max_coverage(samples: Column) -> Column:
    return F.array_max(F.transform(samples, coverage))


def max_bias(samples: Column) -> Column:
    return F.array_max(F.transform(samples, strand_bias))


def ranked_alleles(sample: Column) -> Column:
    """Array of (base, n) by falling count, then by base."""
    rows = lambda s: F.array(*[F.struct((-allele(s, b)).alias("k"), F.lit(b).alias("base")) for b in BASES])
    return F.transform(F.array_sort(bound(sample, rows)), lambda x: F.struct(x["base"].alias("base"), (-x["k"]).alias("n")))


def n_alleles(sample: Column, min_count: int) -> Column:
    return sum(((allele(sample, b) >= min_count).cast("int") for b in BASES[1:]), (allele(sample, BASES[0]) >= min_count).cast("int"))


# --- site filters -------------------------------------------------------------------


def covered(samples: Column, least: int) -> Column:
    return F.forall(samples, lambda s: coverage(s) >= least)


def unbiased(samples: Column, most: float) -> Column:
    return ~F.exists(samples, lambda s: strand_bias(s) > most)


def polymorphic(samples: Column, min_count: int, each: bool = False) -> Column:
    """Whether two alleles reach ``min_count`` in the pool, or in some sample (``each``)."""
    if each:
        return F.exists(samples, lambda s: n_alleles(s, min_count) >= 2)
    return bound(pooled(samples), lambda s: n_alleles(s, min_count) >= 2)


def is_truth(pos: Column) -> Column:
    """Simulated SNPs stand one behind each multiple of a hundred."""
    return (pos % 100 == 1) & (pos > 1)


# --- measures -----------------------------------------------------------------------


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fst(samples: Column, first: int = 0, second: int = 1) -> Column:
    """Fst of two populations from the pool's two most common alleles; 0 where it is undefined."""

    def count(s: Column, base: Column) -> Column:
        out = F.lit(0)
        for b in BASES:
            out = F.when(base == b, allele(s, b)).otherwise(out)
        return out

    def share(k: int, best: Column) -> Column:
        major, minor = F.element_at(best, 1)["base"], F.element_at(best, 2)["base"]
        s = F.element_at(samples, k + 1)
        both = F.struct(count(s, major).alias("p"), count(s, minor).alias("q"))
        return bound(both, lambda x: F.try_divide(x["p"], x["p"] + x["q"]))

    def ratio(x: Column) -> Column:
        het = lambda p: 1 - p * p - (1 - p) * (1 - p)
        total = het((x["a"] + x["b"]) / 2)
        return F.coalesce(F.try_divide(total - (het(x["a"]) + het(x["b"])) / 2, total), F.lit(0.0))

    shares = bound(ranked_alleles(pooled(samples)), lambda best: F.struct(share(first, best).alias("a"), share(second, best).alias("b")))
    return bound(shares, ratio)


def _chi_p(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact test: the tables with these margins that are at most as likely."""
    row, col, n = a + b, a + c, a + b + c + d
    lf = lambda k: math.lgamma(k + 1)
    const = lf(row) + lf(n - row) + lf(col) + lf(n - col) - lf(n)
    logp = lambda x: const - lf(x) - lf(row - x) - lf(col - x) - lf(n - row - col + x)
    here = logp(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, row + col - n), min(row, col) + 1) if (p := logp(x)) <= here + 1e-7))


def goodness_p(a: int, b: int) -> float:
    """Chi-square test of two counts against equal shares."""
    return _chi_p((a - b) ** 2 / (a + b)) if a + b else 1.0


def contingency_p(a: int, b: int, c: int, d: int) -> float:
    """Chi-square test of a 2 x 2 table, one added to each count, with Yates's correction."""
    a, b, c, d = a + 1, b + 1, c + 1, d + 1
    n, diff = a + b + c + d, abs(a * d - b * c)
    return _chi_p(n * max(0.0, diff - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))


def significance(p: float) -> float:
    """-log10 of a probability; 100 for 0."""
    return 100.0 if p <= 0 else max(0.0, -math.log10(p))


@F.pandas_udf(DoubleType())
def fisher_score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for cols in parts:
        yield pd.Series([significance(fisher_p(*map(int, x))) for x in zip(*cols, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def contingency_score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for cols in parts:
        yield pd.Series([significance(contingency_p(*map(int, x))) for x in zip(*cols, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def goodness_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for cols in parts:
        yield pd.Series([significance(goodness_p(*map(int, x))) for x in zip(*cols, strict=True)], dtype=float)


def multimeasure(sites: DataFrame, *, bias: str = "maxfraction", measure: str = "fst", least: int = 1) -> DataFrame:
    """(chrom, pos, is_snp, is_outlier, strand_bias, measure) of covered sites.

    ``bias`` is maxfraction (the largest share), alleleimbalance (Fisher's test of
    strand against the two main alleles) or maxsignificance (the largest test of
    equal strands); ``measure`` is fst or fet (Fisher's test of the two populations).
    """
    pool, samples = pooled(F.col("samples")), F.col("samples")
    best = F.col("__best")

    def of(s: Column, rank: int, part: str) -> Column:
        base, out = F.element_at(best, rank)["base"], F.lit(0).cast("bigint")
        for b in BASES:
            value = allele(s, b) if part == "both" else s[f"{b}{part}"]
            out = F.when(base == b, value).otherwise(out)
        return out

    rows = sites.filter(covered(samples, least)).withColumn("__pool", pool).withColumn("__best", ranked_alleles(F.col("__pool")))
    if bias == "maxfraction":
        biased = max_bias(samples)
    elif bias == "alleleimbalance":
        p = F.col("__pool")
        biased = fisher_score(of(p, 1, "f"), of(p, 1, "r"), of(p, 2, "f"), of(p, 2, "r"))
    elif bias == "maxsignificance":
        p = F.element_at(F.array_sort(F.transform(samples, lambda s: F.struct((-strand_bias(s)).alias("k"), s.alias("s")))), 1)["s"]
        biased = goodness_score(forward(p), coverage(p) - forward(p))
    else:
        raise ValueError(f"unknown strand-bias method {bias!r}")
    if measure == "fst":
        measured = fst(samples)
    elif measure == "fet":
        a, b = F.element_at(samples, 1), F.element_at(samples, 2)
        measured = fisher_score(of(a, 1, "both"), of(a, 2, "both"), of(b, 1, "both"), of(b, 2, "both"))
    else:
        raise ValueError(f"unknown measure {measure!r}")
    return rows.select(
        "chrom", "pos", is_truth(F.col("pos")).alias("is_snp"), F.lit(False).alias("is_outlier"), biased.alias("strand_bias"), measured.alias("measure")
    )


# --- summaries ----------------------------------------------------------------------


def call_snps(sites: DataFrame, *, least: int = 1, min_count: int = 2) -> DataFrame:
    """For each site: simulated, polymorphic, coverage, forward share and reference share of the pool."""
    p = F.col("__pool")
    ref = F.lit(0)
    for b in BASES:
        ref = F.when(F.upper("ref") == b, allele(p, b)).otherwise(ref)
    made = sites.withColumn("__pool", pooled(F.col("samples")))
    return made.select(
        is_truth(F.col("pos")).alias("simulated"),
        (covered(F.col("samples"), least) & (n_alleles(p, min_count) >= 2)).alias("polymorphic"),
        "chrom",
        "pos",
        coverage(p).alias("cov"),
        F.try_divide(forward(p), coverage(p)).alias("fwd_frac"),
        F.try_divide(ref, coverage(p)).alias("ref_frac"),
        F.concat_ws(":", *[allele(p, b) for b in BASES]).alias("counts"),
    )


def confusion(calls: DataFrame, *, total: int, outlier: float = 0.1) -> DataFrame:
    """One row: true and false positives, the misses among ``total`` simulated SNPs, mean and deviation of shares and coverage."""
    tp, fp = F.col("simulated") & F.col("polymorphic"), ~F.col("simulated") & F.col("polymorphic")
    return calls.agg(
        F.count_if(tp).alias("tp"),
        F.count_if(fp).alias("fp"),
        F.count_if(F.col("simulated") & ~F.col("polymorphic")).alias("fn_call"),
        (F.lit(total) - F.count_if("simulated")).alias("fn_pileup"),
        F.avg(F.when(tp, F.col("ref_frac"))).alias("mean_ref_frac"),
        F.stddev_pop(F.when(tp, F.col("ref_frac"))).alias("std_ref_frac"),
        F.avg(F.when(tp, F.col("fwd_frac"))).alias("mean_fwd_frac"),
        F.stddev_pop(F.when(tp, F.col("fwd_frac"))).alias("std_fwd_frac"),
        F.avg(F.when(tp, F.col("cov"))).alias("mean_cov"),
        F.stddev_pop(F.when(tp, F.col("cov"))).alias("std_cov"),
        F.count_if(tp & (F.abs(F.col("ref_frac") - 0.5) > outlier)).alias("n_outlier"),
    )


def within(column: Column, low: float, high: float) -> Column:
    return column.between(low, high)


def histogram(df: DataFrame, *, value: str, step: float, truth: str | None = None) -> DataFrame:
    """Counts by bin floor(value / step); true and false separately with ``truth``."""
    bin = F.floor(F.col(value) / step).cast("bigint").alias("bin")
    if truth is None:
        return df.groupBy(bin).agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(bin).agg(F.count_if(F.col(truth)).alias("n_true"), F.count_if(~F.col(truth)).alias("n_false"))


def reverse_cumulative(hist: DataFrame, *, bin: str = "bin", n: str = "n") -> DataFrame:
    """A histogram with the share of rows at or above each bin.  The bins, not the rows, meet in one task."""
    down = Window.orderBy(F.desc(bin)).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hist.withColumn("share_above", F.sum(n).over(down) / F.sum(n).over(total))


def mapq_histogram(df: DataFrame, *, mapq: str = "mapq", flag: str = "flag", width: int = 5) -> DataFrame:
    """Reads by bin of mapping quality: all, mapped, unmapped, properly paired."""
    bit = lambda b: F.col(flag).bitwiseAND(F.lit(b)) != 0
    return df.groupBy(F.floor(F.col(mapq) / width).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~bit(4)).alias("n_mapped"), F.count_if(bit(4)).alias("n_unmapped"), F.count_if(bit(2)).alias("n_proper")
    )


def te_frequency(sites: DataFrame, *, pos: str = "pos", ids: str = "ids") -> DataFrame:
    """(pos, id, n, frequency) of signed ids in an array for each haplotype; id 0 (none) counts as a haplotype only."""
    rows = sites.select(pos, F.size(ids).alias("total"), F.explode(ids).alias("id"))
    counts = rows.groupBy(pos, "total", "id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("id <> 0").select(pos, "id", "n", (F.col("n") / F.col("total")).alias("frequency"))


def genome_stats(genomes: DataFrame, *, seq: str = "seq", read_length: int = 100, reads: int = 1000) -> DataFrame:
    """Number and lengths of genomes, expected coverage of so many reads, and reads for one-fold coverage."""
    length = F.char_length(seq)
    return genomes.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("total"),
        F.avg(length).alias("mean_length"),
        (F.lit(reads * read_length) / F.avg(length)).alias("coverage"),
        F.ceil(F.avg(length) / read_length).alias("reads_for_one"),
    )


# --- ranks --------------------------------------------------------------------------


def ranked(df: DataFrame, *, order: Sequence[Column], name: str = "rank", groups: int = 256, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns`` (default all) and a global 1-based rank, without sorting in one task.

    Rows are range-partitioned by the order, sorted and numbered within partitions, and
    written; partition sizes, one row for each, give the offsets.  Written, since Spark
    draws the bounds of ranges from a sample, so two plans over the same rows may not
    share them.  ``order`` must be total.
    """
    kept = list(df.columns if columns is None else columns)
    # the number of the partition, then that of the row in it, in the low 33 bits
    numbered = df.repartitionByRange(groups, *order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("__id"))
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    local = scratch.keep(numbered, "ranks").withColumns({"__part": part, "__rank": row + 1})
    sizes = local.groupBy("__part").agg(F.max("__rank").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col("__part").alias("__p"), before.alias("__before")))
    joined = local.join(offsets, F.col("__part") == F.col("__p"))
    return joined.select(*kept, (F.col("__before") + F.col("__rank")).alias(name))


def top_outliers(df: DataFrame, n: int, *, order: Sequence[Column], key: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """``flag`` marks the first ``n`` rows in ``order`` (total); few keys are broadcast, more go through a shuffle join."""
    top = df.orderBy(*order).limit(n).select(*key, F.lit(True).alias("__top"))
    top = F.broadcast(top) if n <= BROADCAST_ROWS else top
    return df.drop(flag).join(top, list(key), "left").withColumn(flag, F.coalesce("__top", F.lit(False))).drop("__top")


def pick_ranks(df: DataFrame, ranks: Sequence[int] = (), fractions: Sequence[float] = (), *, value: str, order: Sequence[Column], truth: str | None = None) -> DataFrame:
    """(truth, rank, value) at given ranks and at floor(n * fraction), by falling value, for each truth class, null included."""
    kind = F.col(truth) if truth else F.lit(None)
    rows = df.select(kind.cast("boolean").alias("__truth"), F.col(value).alias("__value"), *df.columns)
    classes = [F.col("__truth").desc()] if truth else []
    placed = ranked(rows, order=[*classes, *order], columns=["__truth", "__value"])
    sizes = placed.groupBy("__truth").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    wanted = []
    for _, first, n in sizes:
        wanted += [(first, r) for r in sorted({*ranks, *(int(n * f) for f in fractions)}) if 1 <= r <= n]
    own = F.create_map(*[F.lit(x) for first, r in wanted for x in (first + r - 1, r)]) if wanted else F.lit(None).cast("map<bigint,int>")
    found = placed.filter(F.col("rank").isin([first + r - 1 for first, r in wanted]))
    return found.select(F.col("__truth").alias("truth"), F.try_element_at(own, F.col("rank")).alias("rank"), F.col("__value").alias("value"))


def roc_points(df: DataFrame, points: int, *, order: Sequence[Column], positive: str = "is_outlier") -> DataFrame:
    """(rank, tpr, fpr) at every n / points-th row in ``order``."""
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive)).alias("p")).first()
    n, p = sizes["n"], sizes["p"]
    step = max(1, n // points)
    rows = ranked(df, order=order, columns=[positive]).select("rank", F.col(positive).cast("int").alias("hit"))
    blocks = rows.groupBy(F.floor((F.col("rank") - 1) / step).alias("block")).agg(F.max("rank").alias("rank"), F.sum("hit").alias("hit"), F.count(F.lit(1)).alias("size"))
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.sum("hit").over(up)
    made = blocks.select("rank", "size", hits.alias("hits")).filter(F.col("size") == step)
    return made.select("rank", F.try_divide(F.col("hits"), F.lit(p)).alias("tpr"), F.try_divide(F.col("rank") - F.col("hits"), F.lit(n - p)).alias("fpr"))


def merge_statistics(left: DataFrame, right: DataFrame, *, key: Sequence[str] = ("chrom", "pos"), value: str = "value", take: str = "small") -> DataFrame:
    """Two tables of a statistic joined by site; ``take`` is take1, take2, small or large."""
    a, b = F.col("__a"), F.col("__b")
    chosen = {"take1": a, "take2": b, "small": F.least(a, b), "large": F.greatest(a, b)}[take]
    joined = left.select(*key, F.col(value).alias("__a")).join(right.select(*key, F.col(value).alias("__b")), list(key))
    return joined.select(*key, chosen.alias(value))


def of_chromosomes(rows: DataFrame, names: Sequence[object], *, chrom: str = "chrom") -> DataFrame:
    """The rows of the listed chromosomes; all of them for an empty list."""
    return rows.filter(F.col(chrom).isin(*names)) if names else rows


def spaced_sites(sites: DataFrame, *, step: int = 100) -> DataFrame:
    """Coverage, forward share and reference share of the first sample at every ``step``-th position from the first."""
    first = F.element_at("samples", 1)
    rows = sites.filter(F.col("pos") % step == 1).withColumn("__s", first)
    s = F.col("__s")
    cov = coverage(s).cast("double")
    own = F.coalesce(*[F.when(F.upper("ref") == b, allele(s, b)) for b in BASES])
    return rows.select("chrom", "pos", "ref", cov.cast("bigint").alias("cov"), F.try_divide(forward(s), cov).alias("fwd_frac"), F.try_divide(own, cov).alias("ref_frac"))
