"""Command line: ``python -m gapline COMMAND ...``; run it through spark-submit on a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.config import Config
from gapline.deploy import ship
from gapline.functions import cigar as C
from gapline.operators import clusters, label, readout, segments, simulate
from gapline.plans import caller, programs
from gapline.sources import bam, sinks, text


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gapline")
    commands = parser.add_subparsers(dest="command", required=True)
    call = commands.add_parser("clusters", help="clusters of segments of a SAM file")
    call.add_argument("sam")
    call.add_argument("out")
    call.add_argument("--min-segment", type=int, default=100)
    call.add_argument("--max-gap", type=int, default=50)
    call.add_argument("--min-overhang", type=int, default=200)
    snp = commands.add_parser("snps", help="SNP calls of an mpileup file")
    snp.add_argument("pileup")
    snp.add_argument("out")
    snp.add_argument("--min-quality", type=int, default=20)
    fst = commands.add_parser("fst", help="Fst of a strand-sync file")
    fst.add_argument("sync")
    fst.add_argument("out")
    caller_ = commands.add_parser("call", help="scored clusters of alignments, with hits of their segments")
    for name in ("alignments", "hits", "repeats", "gaps", "blacklist", "out"):
        caller_.add_argument(name)
    caller_.add_argument("--min-segment", type=int, default=100)
    caller_.add_argument("--max-gap", type=int, default=50)
    caller_.add_argument("--min-overhang", type=int, default=200)
    cut = commands.add_parser("segments", help="sequences of the anchored segments, named as hits have to name them")
    cut.add_argument("alignments")
    cut.add_argument("out")
    labels = commands.add_parser("label", help="TP, FP or Special for candidates of a BED file, by a BED file of true insertions")
    for name in ("candidates", "truth", "out"):
        labels.add_argument(name)
    labels.add_argument("--flank", type=int, default=50)
    simulated = commands.add_parser("simulate", help="random insertions on the sequences of a FASTA file, and the genomes that carry them")
    for name in ("fasta", "out"):
        simulated.add_argument(name)
    simulated.add_argument("--elements", type=int, default=1)
    simulated.add_argument("--germline", type=int, default=500)
    simulated.add_argument("--somatic", type=int, default=20, help="of each genome")
    simulated.add_argument("--genomes", type=int, default=10_000)
    simulated.add_argument("--sub-population", type=int, default=50)
    simulated.add_argument("--seed", type=int, default=1)
    return parser


def _alignments(spark: SparkSession, path: str) -> DataFrame:
    """A BAM or a SAM file, with tid the name of the reference and an id."""
    rows = bam.read_bam(spark, path) if path.rstrip("/").endswith(".bam") else text.read_sam(spark, path)
    rows = rows.drop("aln_id").filter("rname is not null and rname <> '*'").withColumn("tid", F.col("rname"))
    return rows.withColumn("aln_id", F.xxhash64("qname", "flag", "rname", "pos", "cigar"))


def _intervals(spark: SparkSession, path: str) -> DataFrame:
    return text.read_bed(spark, path).select(F.col("chrom").alias("tid"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))


def _scorer(rows: DataFrame) -> Column:
    """Stands in for a trained model: the share of a cluster's segments with hits."""
    return F.col("aligned_frac")


def _call(spark: SparkSession, args: argparse.Namespace) -> None:
    config = Config(min_segment=args.min_segment, max_gap=args.max_gap, min_overhang=args.min_overhang)
    rows = _alignments(spark, args.alignments)
    measured = segments.with_spans(rows.filter(segments.valid(F.col("flag"))))
    measured = measured.withColumn("ops", C.parse(F.col("cigar")))
    divergence = C.divergence(F.col("nm"), F.col("nn"), F.col("ops"))
    measured = measured.select("tid", divergence.alias("divergence"), C.map_length(F.col("ops")).alias("map_len"), "read_len")
    lengths = segments.with_spans(rows).groupBy("tid").agg(F.max("aln_end").alias("length"))
    # the longest of all, and of equally long ones the first by name
    numbered = lengths.withColumn("name", F.col("tid")).withColumn("tid", F.xxhash64("tid"))
    background = clusters.background_stats(measured.withColumn("tid", F.xxhash64("tid")), numbered)
    hits = spark.read.option("header", True).option("sep", "\t").csv(args.hits)
    kinds = {"query_start": "int", "query_end": "int", "map_len": "int", "score": "int", "divergence": "double", "hit_id": "bigint"}
    hits = hits.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    known = [_intervals(spark, p) for p in (args.repeats, args.gaps, args.blacklist)]
    found = caller.call(rows, hits, *known, background, _scorer, config)
    sinks.write_table(found.select("tid", "ref_start", "ref_end", "num_seg_raw", "clt_type", "aligned_frac", "probability", "high_quality"), args.out)


def _segments(spark: SparkSession, args: argparse.Namespace) -> None:
    found = caller.find_segments(_alignments(spark, args.alignments))
    sinks.write_fasta(readout.segment_sequences(found), args.out)


def _label(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = text.read_bed(spark, args.candidates).withColumn("cand_id", F.concat_ws(":", "chrom", "start", "end", "name"))
    truth = text.read_bed(spark, args.truth).select("chrom", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.concat_ws(":", "chrom", "start", "end", "name").alias("t_id"))
    made = label.classify(rows.select("cand_id", "chrom", "start", "end").distinct(), truth, flank=args.flank)
    sinks.write_labelled(made.select("chrom", "start", "end", "n_truth", "truth_id", "label"), args.out)


def _simulate(spark: SparkSession, args: argparse.Namespace) -> None:
    contigs = text.read_fasta(spark, args.fasta, check=True).select(F.col("name").alias("chrom"), F.char_length("seq").alias("length"))
    contigs = contigs.withColumn("tid", F.col("chrom"))
    made = simulate.landscape(contigs, args.elements, seed=args.seed, germline=args.germline, somatic_per_genome=args.somatic, genomes=args.genomes)
    sinks.write_table(made, f"{args.out}/insertions")
    sinks.write_table(simulate.assign_genomes(made, args.genomes, seed=args.seed, sub=args.sub_population), f"{args.out}/carriers", by=["sub_population"])


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("gapline").getOrCreate()
    ship(spark)
    if args.command == "clusters":
        config = Config(min_segment=args.min_segment, max_gap=args.max_gap, min_overhang=args.min_overhang)
        rows = text.read_sam(spark, args.sam).filter("rname <> '*'").withColumn("tid", F.col("rname"))
        rows = rows.withColumn("aln_id", F.xxhash64("qname", "flag", "rname", "pos", "cigar"))
        found = clusters.cluster_bounds(caller.find_clusters(caller.find_segments(rows, config), config))
        sinks.write_table(found.select("tid", "ref_start", "ref_end", "num_seg"), args.out)
    elif args.command == "snps":
        programs.snp_caller(spark, args.pileup, args.out, min_quality=args.min_quality)
    elif args.command == "fst":
        programs.fst_from_strand_sync(spark, args.sync, args.out)
    else:
        {"call": _call, "segments": _segments, "label": _label, "simulate": _simulate}[args.command](spark, args)


if __name__ == "__main__":
    main()
