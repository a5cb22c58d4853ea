"""Programs: files in, files out, by composition of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.names import read_origin
from gapline.operators import label, popgen
from gapline.sources import sinks, text


def snp_caller(spark: SparkSession, pileup: str, out: str, *, min_quality: int = 20, least: int = 1, min_count: int = 2) -> DataFrame:
    calls = popgen.call_snps(text.read_mpileup(spark, pileup, min_quality), least=least, min_count=min_count)
    sinks.write_table(calls, out, missing="Na")
    return calls


def mpileup_to_strand_sync(spark: SparkSession, pileup: str, out: str, *, min_quality: int = 0) -> None:
    sinks.write_strand_sync(text.read_mpileup(spark, pileup, min_quality), out)


def strand_sync_to_sync(spark: SparkSession, path: str, out: str, *, least: int = 1, most_bias: float = 0.5, min_count: int = 1) -> None:
    s = F.col("samples")
    rows = text.read_strand_sync(spark, path)
    sinks.write_sync(rows.filter(popgen.covered(s, least) & popgen.unbiased(s, most_bias) & popgen.polymorphic(s, min_count)), out)


def fst_from_strand_sync(spark: SparkSession, path: str, out: str, *, least: int = 1, most_bias: float = 0.5, min_count: int = 1) -> DataFrame:
    s = F.col("samples")
    rows = text.read_strand_sync(spark, path).filter(popgen.covered(s, least) & popgen.unbiased(s, most_bias) & popgen.polymorphic(s, min_count))
    made = rows.select("chrom", "pos", popgen.fst(s).alias("value"))
    sinks.write_fst(made, out)
    return made


def multimeasure(spark: SparkSession, path: str, out: str, *, bias: str, measure: str, least: int = 1, outliers: int = 0) -> DataFrame:
    """The table of measures, its ``outliers`` largest marked."""
    rows = popgen.multimeasure(text.read_strand_sync(spark, path), bias=bias, measure=measure, least=least)
    if outliers:
        order = [F.col("measure").desc(), F.col("chrom"), F.col("pos")]
        rows = popgen.top_outliers(rows, outliers, order=order, key=["chrom", "pos"])
    rows = rows.select("chrom", "pos", "is_snp", "is_outlier", "strand_bias", "measure")
    sinks.write_table(rows, out)
    return rows


def roc(spark: SparkSession, path: str, points: int) -> DataFrame:
    rows = text.read_multimeasure(spark, path)
    return popgen.roc_points(rows, points, order=[F.col("strand_bias").desc(), F.col("chrom"), F.col("pos")])


def label_candidates(
    candidates: DataFrame, truth: DataFrame, segments: DataFrame, alignments: DataFrame, carriers: DataFrame, *, flank: int = 50
) -> DataFrame:
    """Candidates with TP, FP or Special.

    ``segments`` has cand_id, qname and pos of the candidates' segments, ``alignments``
    qname, pos and chrom, ``carriers`` (t_id, hg).  A TP whose reads all come from
    other chromosomes or from genomes without the insertion becomes FP.
    """
    made = label.classify(candidates, truth, flank=flank)
    reads = label.segment_reads(segments, made.filter(F.col("label") == label.TP), alignments).withColumn("origin", read_origin(F.col("qname")))
    named = reads.join(made.select("cand_id", "truth_id"), "cand_id")
    known = carriers.select(F.col("t_id").alias("truth_id"), "hg", F.lit(True).alias("carries")).distinct()
    joined = named.withColumn("hg", F.col("origin.hg")).join(known, ["truth_id", "hg"], "left")
    supported = joined.select("cand_id", (F.coalesce("carries", F.lit(False)) & (F.col("origin.chrom") == F.col("chrom"))).alias("supports"))
    return label.demote(made, supported)


def label_support(alignments: DataFrame, truth: DataFrame, carriers: DataFrame, *, min_frequency: float = 0.0001, flank: int = 50) -> DataFrame:
    """Reads over true insertions of more than a frequency, with ``supports``."""
    ins = truth.filter(F.col("freq") > min_frequency).select("chrom", F.col("l_bp").alias("i_start"), F.col("r_bp").alias("i_end"), "ins_id")
    origin = read_origin(F.col("qname"))
    reads = alignments.withColumns({"origin_chrom": origin["chrom"], "hg": origin["hg"]})
    return label.support(reads, ins, carriers, flank=flank)
