"""Seeded simulators of insertions, genomes and reads.

Random numbers are hashes of a seed and the row's own keys, so a row's draw does
not depend on how Spark deals rows to tasks, and a lost task draws the same again.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapline.operators.dsl import mutate, mutate_long_read, splice_column

SCALE = float(1 << 53)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that seed and keys fix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / SCALE


def between(low: Column | int, high: Column | int, draw: Column) -> Column:
    """A whole number in [low, high]."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (a + F.floor(draw * (b - a + 1))).cast("bigint")


def allocate(contigs: DataFrame, total: int, *, order: str = "tid", length: str = "length") -> DataFrame:
    """``n`` of ``total`` for each contig in proportion to its length; the last gets the remainder."""
    everything = Window.partitionBy()
    share = F.floor(F.lit(total).cast("bigint") * F.col(length) / F.sum(length).over(everything))
    made = contigs.withColumn("n", share.cast("bigint"))
    rest = F.lit(total) - F.sum("n").over(everything)
    last = F.col(order) == F.max(order).over(everything)
    return made.withColumn("n", F.col("n") + F.when(last, rest).otherwise(0))


def positions(contigs: DataFrame, *, seed: int, count: str = "n", length: str = "length", chrom: str = "chrom") -> DataFrame:
    """Rising positions in each contig: cumulative random gaps, scaled to its length."""
    rows = contigs.filter(F.col(count) > 0).select(chrom, length, count, F.explode(F.sequence(F.lit(1), F.col(count))).alias("k"))
    gap = uniform(seed, F.col(chrom), F.col("k")) * 2 * F.col(length) / (F.col(count) + 1)
    up = Window.partitionBy(chrom).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.least(F.floor(F.sum(gap).over(up)) + F.col("k"), F.col(length) - F.col(count) + F.col("k") - 1)
    return rows.select(chrom, "k", F.greatest(F.lit(1), pos).cast("bigint").alias("pos"))


def landscape(
    contigs: DataFrame, n_te: int, *, seed: int, germline: int, somatic_per_genome: int, genomes: int, te_length: int = 1000,
    truncated: float = 0.1, nested: float = 0.1, tsd: tuple[int, int] = (6, 8),
) -> DataFrame:
    """Random insertion definitions: chrom, pos, ins_id, kind, te, strand, definition, freq.

    Germline insertions have a frequency from 0.1 to 1, somatic ones one genome's share.
    """
    total = germline + somatic_per_genome * genomes
    sites = positions(allocate(contigs, total), seed=seed)
    u = lambda k: uniform(seed + k, F.col("chrom"), F.col("pos"))
    place = F.row_number().over(Window.partitionBy("__all").orderBy(u(1), "chrom", "pos"))
    rows = sites.withColumn("__all", F.lit(0)).withColumn("__n", place).withColumn("kind", F.when(F.col("__n") <= germline, "germline").otherwise("somatic"))
    te = between(1, n_te, u(2))
    cut = between(te_length // 10, te_length // 2, u(4))
    strand = F.when(u(5) < 0.5, "+").otherwise("-")
    inner = F.concat(F.lit("{"), between(100, max(101, te_length // 2), u(6)), F.lit(":$"), between(1, n_te, u(7)), F.lit("+}"))
    definition = F.concat(
        F.lit("$"),
        te,
        F.when(u(3) < truncated, F.concat(F.lit("[1.."), cut, F.lit("]"))).otherwise(""),
        strand,
        F.when(u(8) < nested, inner).otherwise(""),
        F.lit(" "),
        between(tsd[0], tsd[1], u(9)),
        F.lit("bp"),
    )
    freq = F.when(F.col("kind") == "germline", 0.1 + 0.9 * u(10)).otherwise(1.0 / genomes)
    return rows.select(
        "chrom", "pos", F.concat_ws("_", "chrom", "pos").alias("ins_id"), "kind", te.alias("te"), strand.alias("strand"), definition.alias("definition"), freq.alias("freq")
    )


def assign_genomes(insertions: DataFrame, genomes: int, *, seed: int, sub: int | None = None) -> DataFrame:
    """(ins_id, hg, sub_population, column): germline insertions by frequency, a somatic one in one genome."""
    one = between(0, genomes - 1, uniform(seed + 1, F.col("ins_id"))).cast("int")
    asked = F.when(F.col("kind") == "germline", F.sequence(F.lit(0), F.lit(genomes - 1))).otherwise(F.array(one))
    rows = insertions.select("ins_id", "kind", "freq", F.explode(asked).alias("hg"))
    carried = (F.col("kind") != "germline") | (uniform(seed, F.col("ins_id"), F.col("hg")) < F.col("freq"))
    size = sub or genomes
    return rows.filter(carried).select("ins_id", "hg", F.floor(F.col("hg") / size).cast("int").alias("sub_population"), (F.col("hg") % size).alias("column"))


def build_genomes(chassis: DataFrame, insertions: DataFrame, carriers: DataFrame, resolved: DataFrame, *, genomes: int) -> DataFrame:
    """(chrom, hg, seq) of every genome: the chassis with its insertions spliced in.

    ``resolved`` has ins_id, seq and tsd of each insertion.
    """
    all_hg = chassis.select("chrom", F.col("seq").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(genomes - 1))).alias("hg"))
    own = carriers.join(insertions.select("ins_id", "chrom", "pos"), "ins_id").join(resolved.select("ins_id", "seq", "tsd"), "ins_id")
    lists = own.groupBy("chrom", "hg").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "seq", "tsd")).alias("ins"))
    joined = all_hg.join(lists, ["chrom", "hg"], "left")
    return joined.select("chrom", "hg", F.when(F.col("ins").isNull(), F.col("base")).otherwise(splice_column(F.col("base"), F.col("ins"))).alias("seq"))


def target_reads(unit: str, value: float, *, genome: int, read_length: int, pairs: bool = False, inner: int = 0) -> int:
    """Reads for a target given as reads (r), coverage (c) or physical coverage (pc)."""
    if unit == "pc":
        return int(value * genome / (2 * read_length + inner if pairs else read_length))
    if unit == "c":
        return int(value * genome / (read_length * (2 if pairs else 1)))
    if unit == "r":
        return int(value)
    raise ValueError(f"unknown unit {unit!r}")


def length_sampler(histogram: Sequence[tuple[int, float]]) -> list[tuple[int, float]]:
    """(length, cumulative share) of a read-length histogram; equal lengths add up."""
    sums: dict[int, float] = {}
    for length, n in histogram:
        sums[length] = sums.get(length, 0.0) + n
    total, out, acc = sum(sums.values()), [], 0.0
    for length in sorted(sums):
        acc += sums[length] / total
        out.append((length, acc))
    return out


def long_reads(
    genomes: DataFrame, reads_per_genome: int, *, seed: int, mean: int = 8690, low: int = 6000, high: int = 16000, error: float = 0.1,
    histogram: Sequence[tuple[int, float]] | None = None,
) -> DataFrame:
    """Long reads (name, seq, chrom, hg, pos, reverse); lengths are gamma or follow a histogram, within [low, high]."""
    steps = length_sampler(histogram) if histogram else None

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chrom, hg, seq in zip(batch["chrom"], batch["hg"], batch["seq"], strict=True):
                rng, rows = random.Random(f"{seed}/{chrom}/{hg}"), []
                for k in range(reads_per_genome):
                    if steps:
                        x = rng.random()
                        size = next((n for n, acc in steps if x <= acc), steps[-1][0])
                    else:
                        size = int(rng.gammavariate(4.0, mean / 4.0))
                    size = min(max(size, low), high, len(seq))
                    at = rng.randint(0, len(seq) - size)
                    reverse = rng.random() < 0.5
                    part, _ = mutate_long_read(seq[at : at + size], error, rng)
                    if reverse:
                        part = part[::-1].translate(str.maketrans("ACGT", "TGCA"))
                    rows.append((f"{k};{chrom}_hg{hg}:{at}", part, chrom, hg, at, reverse))
                yield pd.DataFrame(rows, columns=["name", "seq", "chrom", "hg", "pos", "reverse"])

    return genomes.select("chrom", "hg", "seq").mapInPandas(draw, "name string, seq string, chrom string, hg int, pos int, reverse boolean")


def short_reads(
    genomes: DataFrame, reads_per_genome: int, *, seed: int, length: int = 150, error: float = 0.0005, paired: bool = True,
    inner: int = 200, deviation: int = 20, chimera: float = 0.0,
) -> DataFrame:
    """Single (mate 1 only) or paired reads (name, mate, seq); a chimeric mate comes from a random place."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flip = str.maketrans("ACGT", "TGCA")
        for batch in batches:
            for chrom, hg, seq in zip(batch["chrom"], batch["hg"], batch["seq"], strict=True):
                rng, rows = random.Random(f"{seed}/{chrom}/{hg}"), []
                for k in range(reads_per_genome):
                    gap = max(1, round(rng.gauss(inner, deviation))) if paired else 0
                    whole = min(len(seq), (2 * length + gap) if paired else length)
                    at = rng.randint(0, len(seq) - whole)
                    name = f"{k};{chrom}_hg{hg}:{at}"
                    rows.append((name, 1, mutate(seq[at : at + length], error, rng)))
                    if paired:
                        end = rng.randint(min(length, len(seq)), len(seq)) if rng.random() < chimera else at + whole
                        rows.append((name, 2, mutate(seq[max(0, end - length) : end], error, rng)[::-1].translate(flip)))
                yield pd.DataFrame(rows, columns=["name", "mate", "seq"])

    return genomes.select("chrom", "hg", "seq").mapInPandas(draw, "name string, mate int, seq string")


def even_pairs(spark: SparkSession, chassis: DataFrame, *, length: int, inner: int, step: int) -> DataFrame:
    """Error-free pairs at every ``step`` bases."""
    size = 2 * length + inner
    rows = chassis.filter(F.char_length("seq") >= size)
    rows = rows.select("chrom", "seq", F.explode(F.sequence(F.lit(0), F.char_length("seq") - size, F.lit(step))).alias("at"))
    second = F.translate(F.reverse(F.substr("seq", F.col("at") + 1 + length + inner, F.lit(length))), "ACGT", "TGCA")
    return rows.select("chrom", "at", F.substr("seq", F.col("at") + 1, F.lit(length)).alias("first"), second.alias("second"))
