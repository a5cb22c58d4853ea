"""Queries that write a table in a format and read it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import popgen
from gapline.plans.population import SITE_SQL, _sites
from gapline.plans.registry import query, six
from gapline.plans.views import view
from gapline.sources import bam, scratch, sinks, text


def _through(spark: SparkSession, lines: Column, rows: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    path = scratch.folder(spark, "lines")
    rows.select(lines.alias("value")).write.text(path)
    return read(spark, path)


def _tabbed(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


@query("""
SELECT qname, flag, concat('chr', tid) AS rname, pos, mapq, cigar, nm, 0 AS nn, CAST(mapq % 9 AS INT) AS score FROM {aln}""")
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    star, zero = F.lit("*"), F.lit("0")
    tags = [F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("AS:i:"), (F.col("mapq") % 9).cast("string"))]
    line = _tabbed("qname", "flag", F.concat(F.lit("chr"), "tid"), F.col("pos") + 1, "mapq", "cigar", star, zero, zero, star, star, *tags)
    return _through(spark, line, view(spark, sf_dir, "aln"), text.read_sam).select("qname", "flag", "rname", "pos", "mapq", "cigar", "nm", "nn", "score")


REFERENCES = [(f"chr{k}", 3_000_000) for k in range(5)]


def _bam(spark: SparkSession, sf_dir: str) -> str:
    path = scratch.folder(spark, "bam")
    rows = view(spark, sf_dir, "aln").withColumn("seq", F.substr(F.lit("ACGTN"), F.lit(1), (F.col("pos") % 6).cast("int")))
    bam.write_bam(rows, REFERENCES, path)
    return path


@query("""
SELECT tid, concat('chr', tid) AS rname, qname, flag, pos, mapq, cigar, left('ACGTN', CAST(pos % 6 AS INT)) AS seq, nm FROM {aln}""")
def bam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bam.read_bam(spark, f"{_bam(spark, sf_dir)}/tid=*").select("tid", "rname", "qname", "flag", "pos", "mapq", "cigar", "seq", "nm")


@query("SELECT tid, qname, flag, pos, cigar FROM {aln} WHERE tid = 2")
def bam_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of one chromosome, which opens no file of another."""
    return bam.read_chromosome(spark, _bam(spark, sf_dir), 2).select("tid", "qname", "flag", "pos", "cigar")


@query("SELECT aln_id, tid, pos, qname FROM {aln} WHERE aln_id IN (SELECT min(aln_id) FROM {aln} GROUP BY qname)")
def bam_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments with the ids of each read's first."""
    rows = view(spark, sf_dir, "aln")
    return bam.lookup(rows, rows.groupBy("qname").agg(F.min("aln_id").alias("aln_id"))).select("aln_id", "tid", "pos", "qname")


@query("""
SELECT concat('chr', tid) AS chrom, i_start AS start, i_end AS "end", concat('i', ivl_id) AS name, CAST(ivl_id % 7 AS DOUBLE) AS score,
  CASE WHEN ivl_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {ivl}""")
def bed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ivl_id")
    line = _tabbed(F.concat(F.lit("chr"), "tid"), "i_start", "i_end", F.concat(F.lit("i"), k), k % 7, F.when(k % 2 == 0, "+").otherwise("-"))
    return _through(spark, line, view(spark, sf_dir, "ivl"), text.read_bed)


@query("SELECT ivl_id, i_start, i_end FROM {ivl} WHERE tid = 3 AND i_start < 1000000 AND i_end > 250000")
def bed_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ivl")
    found = text.fetch(rows, 3, 250_000, 1_000_000, chrom_col="tid", start_col="i_start", end_col="i_end")
    return found.select("ivl_id", "i_start", "i_end")


@query("SELECT concat('d', doc_id) AS name, seq FROM {dna}")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "fasta")
    sinks.write_fasta(view(spark, sf_dir, "dna").withColumn("name", F.concat(F.lit("d"), "doc_id")), path, width=60)
    return text.read_fasta(spark, path).select("name", "seq")


@query("SELECT concat('d', doc_id) AS name, CAST(length(seq) AS INT) AS length FROM {dna}")
def fai_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _tabbed(F.concat(F.lit("d"), "doc_id"), F.char_length("seq"), F.lit(0), F.lit(60), F.lit(61))
    return _through(spark, line, view(spark, sf_dir, "dna"), text.read_fai)


@query("""
SELECT concat('d', doc_id, '/', CAST(doc_id % 2 + 1 AS INT)) AS name, seq, repeat('I', length(seq)) AS qual FROM {dna}""")
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates' folders, read as one table of four lines a record."""
    path = scratch.folder(spark, "fastq")
    rows = view(spark, sf_dir, "dna").select(F.concat(F.lit("d"), "doc_id").alias("name"), "seq", (F.col("doc_id") % 2 + 1).cast("int").alias("mate"))
    sinks.write_fastq(rows, path, mate="mate")
    parts = F.split("value", "\n")
    found = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace("value", "^@", "").alias("value"))
    return found.select(F.element_at(parts, 1).alias("name"), F.element_at(parts, 2).alias("seq"), F.element_at(parts, 4).alias("qual"))


@query("SELECT concat('TE', p_partkey) AS name, upper(replace(p_type, ' ', '_')) AS class FROM part")
def class_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return _through(spark, _tabbed(F.concat(F.lit("TE"), "p_partkey"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))), rows, text.read_classes)


@query(f"""
WITH {SITE_SQL}
SELECT concat('c', chrom) AS chrom, pos, ref, xa + xt + xc + xg AS cov1, ya + yt + yc + yg AS cov2, xf AS fwd1, yf AS fwd2 FROM r""")
def strand_sync_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "sync")
    sinks.write_strand_sync(_sites(spark, sf_dir).withColumn("chrom", F.concat(F.lit("c"), "chrom")), path)
    rows = text.read_strand_sync(spark, path)
    a, b = F.element_at("samples", 1), F.element_at("samples", 2)
    return rows.select(
        "chrom", "pos", "ref", popgen.coverage(a).alias("cov1"), popgen.coverage(b).alias("cov2"), popgen.forward(a).alias("fwd1"), popgen.forward(b).alias("fwd2")
    )


@query("""
SELECT concat('c', chrom) AS chrom, pos, 'A' AS ref, a1 + t1 AS cov, a1 AS n_ref, t1 AS n_alt FROM (SELECT chrom, pos, a1, t1 FROM {site}) WHERE a1 + t1 > 0""")
def mpileup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "site").filter("a1 + t1 > 0").select(
        F.concat(F.lit("c"), "chrom").alias("chrom"), "pos", F.concat(F.repeat(F.lit("."), F.col("a1").cast("int")), F.repeat(F.lit("t"), F.col("t1").cast("int"))).alias("b")
    )
    line = _tabbed("chrom", "pos", F.lit("A"), F.char_length("b"), F.concat(F.lit("^]"), "b", F.lit("$")), F.repeat(F.lit("I"), F.char_length("b")))
    found = _through(spark, line, rows, text.read_mpileup)
    s = F.element_at("samples", 1)
    return found.select("chrom", "pos", "ref", popgen.coverage(s).alias("cov"), s["Af"].alias("n_ref"), s["Tr"].alias("n_alt"))


@query("SELECT concat('c', chrom) AS chrom, pos, 1 AS first, 2 AS second, round(strand_bias, 6) AS value FROM {ord}")
def fst_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "fst")
    sinks.write_fst(view(spark, sf_dir, "ord").select(F.concat(F.lit("c"), "chrom").alias("chrom"), "pos", F.col("strand_bias").alias("value")), path)
    return text.read_fst(spark, path).select("chrom", "pos", "first", "second", six(F.col("value"), "value"))


@query("SELECT concat('c', chrom) AS chrom, pos, measure AS value FROM {ord}")
def measure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _tabbed(F.concat(F.lit("c"), "chrom"), "pos", F.lit("x"), F.col("measure").cast("decimal(18,2)"))
    return _through(spark, line, view(spark, sf_dir, "ord"), text.read_measure)


@query("""
SELECT concat('c', chrom) AS chrom, pos, pos % 2 = 0 AS is_snp, is_outlier, round(strand_bias, 6) AS strand_bias, measure FROM {ord}""")
def multimeasure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "measures")
    rows = view(spark, sf_dir, "ord").select(F.concat(F.lit("c"), "chrom").alias("chrom"), "pos", (F.col("pos") % 2 == 0).alias("is_snp"), "is_outlier", "strand_bias", "measure")
    sinks.write_table(rows, path)
    return text.read_multimeasure(spark, path).select("chrom", "pos", "is_snp", "is_outlier", six(F.col("strand_bias"), "strand_bias"), F.round("measure", 2).alias("measure"))


@query("""
SELECT pos % 100 = 1 AS simulated, is_outlier AS polymorphic, concat('c', chrom) AS chrom, pos, 'A' AS ref, CAST(o_custkey AS INT) AS cov, round(strand_bias, 6) AS fwd_frac FROM {ord} WHERE pos % 5 > 0""")
def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose shares are not known are skipped."""
    share = F.when(F.col("pos") % 5 > 0, F.format_string("%.6f", "strand_bias")).otherwise("Na")
    line = _tabbed((F.col("pos") % 100 == 1).cast("int"), F.col("is_outlier").cast("int"), F.concat(F.lit("c"), "chrom"), "pos", F.lit("A"), "o_custkey", share, share, F.lit("1:2:3:4"))
    return _through(spark, line, view(spark, sf_dir, "ord"), text.read_calls).select("simulated", "polymorphic", "chrom", "pos", "ref", "cov", "fwd_frac")


@query("""
SELECT CAST(o_orderkey AS INT) AS pos, CAST(o_custkey % 9 AS INT) AS tsd, concat_ws(',', o_orderkey % 7, o_custkey % 5) AS ids FROM orders""")
def te_site_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat_ws(" ", "o_orderkey", F.concat(F.lit("tsd="), F.col("o_custkey") % 9), F.col("o_orderkey") % 7, F.col("o_custkey") % 5)
    return _through(spark, line, rows, text.read_te_sites).select("pos", "tsd", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


@query("SELECT concat('id', p_partkey) AS id, p_brand AS family, p_type AS \"order\" FROM part")
def hierarchy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "hierarchy")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("order"), F.concat(F.lit("id"), "p_partkey").alias("id"), F.col("p_brand").alias("family"))
    rows.write.csv(path, sep="\t", header=True)
    return text.read_hierarchy(spark, path)


@query("""
WITH n AS (SELECT CAST(p_size AS INT) AS length, sum(p_partkey % 5 + 1) AS n FROM part GROUP BY ALL) SELECT length, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM n""")
def length_histogram_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = _through(spark, F.concat_ws(" ", "p_size", F.col("p_partkey") % 5 + 1), rows, text.read_length_histogram)
    return found.select("length", six(F.col("share"), "share"))


@query("""
SELECT concat('chr', tid) AS chrom, i_start AS l_bp, i_end AS r_bp, concat('i', ivl_id) AS ins_id, '+' AS strand, CAST(ivl_id % 10 AS DOUBLE) / 10 AS freq
FROM {ivl} WHERE ivl_id % 10 > 2""")
def truth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _tabbed(F.concat(F.lit("chr"), "tid"), "i_start", "i_end", F.concat(F.lit("i"), "ivl_id"), F.lit("$1"), F.lit("+"), (F.col("ivl_id") % 10).cast("double") / 10, F.lit(0), F.lit(5))
    found = _through(spark, line, view(spark, sf_dir, "ivl"), lambda s, p: text.read_truth(s, p, min_frequency=0.2))
    return found.select("chrom", "l_bp", "r_bp", "ins_id", "strand", "freq")


@query("""
WITH c AS (SELECT o_custkey AS pos, string_agg(concat('d', o_orderkey % 3), ' ' ORDER BY o_orderkey) AS cells, count(*) AS n FROM orders GROUP BY o_custkey),
m AS (SELECT pos, cells FROM c WHERE n = (SELECT max(n) FROM c))
SELECT CAST(pos AS INT) AS pos, cells FROM m""")
def genome_definition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of full width; narrower ones are none of this format."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("d"), F.col("o_orderkey") % 3).alias("d")))).alias("c")
    )
    rows = rows.select("pos", F.array_join(F.transform("c", lambda x: x["d"]), " ").alias("cells"), F.size("c").alias("n"))
    widest = rows.agg(F.max("n").alias("most"))
    matrix = rows.join(F.broadcast(widest), F.col("n") == F.col("most")).select("pos", "cells")
    path = scratch.folder(spark, "pgd")
    chassis = spark.createDataFrame([("ACGT",)], "chassis string")
    sinks.write_pgd(chassis, spark.createDataFrame([("d0", "$1"), ("d1", "$1+"), ("d2", "$1-")], "name string, expression string"), matrix, path)
    return text.read_pgd(spark, path)[2]


@query("""
SELECT concat_ws('-', clt_type, cluster_id) AS id, 'chr1' AS chrom, CAST(cluster_id * 7 AS INT) AS ref_start, CAST(cluster_id * 7 + 9 AS INT) AS ref_end,
  CASE WHEN flag & 2 <> 0 THEN 1 ELSE 0 END AS assembled, flag FROM {clt} WHERE flag & 64 <> 0""")
def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that annotated clusters are written with; written raw and read again."""
    k = F.col("cluster_id")
    rows = view(spark, sf_dir, "clt").withColumns(
        {
            "tid": F.col("clt_type"), "cluster_idx": k, "chrom": F.lit("chr1"), "ref_start": (k * 7).cast("int"), "ref_end": (k * 7 + 9).cast("int"), "prob": F.lit(0.5),
            **{c: F.lit(1) for c in ("num_seg", "num_left", "num_middle", "num_right")}, **{c: F.lit(".") for c in ("tsd", "ins", "left", "right")},
        }
    )
    path = scratch.folder(spark, "raw")
    sinks.write_raw(sinks.cluster_rows(rows), path)
    return spark.read.parquet(path).select("id", "chrom", "ref_start", "ref_end", "assembled", "flag")


@query("""
SELECT clt_type AS tid, cluster_id AS cluster_idx, concat_ws(chr(9), concat('chr', clt_type), cluster_id * 3, cluster_id * 3 + 5, concat_ws('-', clt_type, cluster_id), flag % 9,
  CASE flag % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '*' END, flag % 3, flag % 9) AS line FROM {clt}""")
def development_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, f = F.col("cluster_id"), F.col("flag")
    rows = view(spark, sf_dir, "clt").select(
        F.concat(F.lit("chr"), "clt_type").alias("chrom"), F.col("clt_type").alias("tid"), k.alias("cluster_idx"), (k * 3).alias("ref_start"), (k * 3 + 5).alias("ref_end"),
        (f % 3).alias("direction"), (f % 9).alias("num_seg"),
    )
    none = rows.select("chrom", "tid", "cluster_idx", F.lit(0).alias("overhang"), F.lit(0).alias("ref_pos"), F.lit("r").alias("qname"))
    return sinks.development_rows(rows, none)[0]


@query("""
SELECT concat('chr', clt_type) AS chrom, CAST(cluster_id + 1 AS BIGINT) AS start, CAST(cluster_id + 4 AS BIGINT) AS "end",
  concat(CASE WHEN flag % 9 < 5 AND (flag % 11)::DOUBLE / 11 <= 2.0::DOUBLE / (2 * (flag % 4) + 1) AND NOT (flag % 2 >= 1 AND flag % 9 > 1) THEN 'soma' ELSE 'germ' END,
    '|', CASE WHEN flag % 3 > 1 THEN 'nested' ELSE '' END) AS origin, concat_ws('_', flag % 2, 0) AS kinds FROM {clt}""")
def legacy_bed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, f = F.col("cluster_id"), F.col("flag")
    rows = view(spark, sf_dir, "clt").withColumns(
        {
            "chrom": F.concat(F.lit("chr"), "clt_type"), "bp_start": k, "bp_end": k + 3, "n_segments": f % 9, "frequency": (f % 11).cast("double") / 11, "n_unsupp": f % 4,
            "n_te": f % 3, "kinds": F.concat_ws("_", f % 2, F.lit(0)), **{c: F.lit(".") for c in ("te", "orient", "supporting", "divergence", "method", "tsd", "inserted", "consensus", "te_size", "state")},
        }
    )
    return sinks.legacy_bed(rows).select("chrom", "start", "end", "origin", "kinds")
