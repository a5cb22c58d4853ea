"""Writers of the text formats.  Each row becomes its lines; Spark writes a file for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions.flags import ASSEMBLED, MAPPED, has_any
from gapline.functions.names import cluster_key
from gapline.operators.legacy import origin_label
from gapline.operators.popgen import BASES, FIELDS, allele


def _write(lines: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def wrap(seq: Column, width: int) -> Column:
    """The sequence in lines of ``width``."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_line(name: Column, seq: Column, width: int = 0) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrap(seq, width) if width else seq)


def write_fasta(df: DataFrame, path: str, *, name: str = "name", seq: str = "seq", width: int = 0, by: list[str] | None = None) -> None:
    """``by`` writes a folder for each value, e.g. for each cluster or genome."""
    _write(df.select(*(by or []), fasta_line(F.col(name), F.col(seq), width).alias("value")), path, by)


def write_fastq(df: DataFrame, path: str, *, name: str = "name", seq: str = "seq", mate: str | None = None, by: list[str] | None = None) -> None:
    """Reads with quality I; ``mate`` adds /1 or /2 to the names and writes a folder for each."""
    label = F.concat(F.col(name), F.lit("/"), F.col(mate)) if mate else F.col(name)
    value = F.concat(F.lit("@"), label, F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.repeat(F.lit("I"), F.char_length(seq)))
    keys = [*(by or []), *([mate] if mate else [])]
    _write(df.select(*keys, value.alias("value")), path, keys or None)


def write_table(df: DataFrame, path: str, *, missing: str = ".", by: list[str] | None = None) -> None:
    """Tab-separated columns without a header; null as ``missing``, probabilities with six decimals."""
    rest = [f for f in df.schema.fields if f.name not in (by or [])]
    text = lambda f: F.format_string("%.6f", f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string")
    value = F.concat_ws("\t", *[F.coalesce(F.when(F.col(f.name).isNotNull(), text(f)), F.lit(missing)) for f in rest])
    _write(df.select(*(by or []), value.alias("value")), path, by)


def write_strand_sync(sites: DataFrame, path: str) -> None:
    sample = lambda s: F.concat_ws(":", *[s[k] for k in FIELDS])
    _write(sites.select(F.concat_ws("\t", "chrom", "pos", "ref", F.array_join(F.transform("samples", sample), "\t")).alias("value")), path)


def sync_line(samples: Column) -> Column:
    """``A:T:C:G:0:0`` of each sample, strands added up."""
    return F.array_join(F.transform(samples, lambda s: F.concat_ws(":", *[allele(s, b) for b in BASES], F.lit("0"), F.lit("0"))), "\t")


def write_sync(sites: DataFrame, path: str) -> None:
    _write(sites.select(F.concat_ws("\t", "chrom", "pos", "ref", sync_line(F.col("samples"))).alias("value")), path)


def write_fst(rows: DataFrame, path: str) -> None:
    value = F.concat_ws("\t", "chrom", "pos", F.lit("1"), F.lit("1"), F.lit("1"), F.concat(F.lit("1:2="), F.col("value")))
    _write(rows.select(value.alias("value")), path)


def write_pgd(chassis: DataFrame, definitions: DataFrame, matrix: DataFrame, path: str) -> None:
    """Header, definitions and matrix as one text, in this order."""
    lines = (
        chassis.select(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("o"), F.concat(F.lit('chassis="'), F.col("chassis"), F.lit('"')).alias("value"))
        .unionByName(definitions.select(F.lit(1).alias("k"), F.xxhash64("name").alias("o"), F.concat_ws("=", "name", "expression").alias("value")))
        .unionByName(matrix.select(F.lit(2).alias("k"), F.col("pos").cast("bigint").alias("o"), F.concat_ws(" ", "pos", "cells").alias("value")))
    )
    _write(lines.orderBy("k", "o").select("value"), path)


def write_labelled(rows: DataFrame, path: str) -> None:
    """A folder of BED lines for each label."""
    write_table(rows, path, missing="*", by=["label"])


#: The columns of the cluster rows that annotated clusters are written with, in order.
CLUSTER_ROW = ("id", "chrom", "ref_start", "ref_end", "prob", "num_seg", "num_left", "num_middle", "num_right", "assembled", "tsd", "ins", "left", "right", "flag")


def cluster_rows(clusters: DataFrame) -> DataFrame:
    """Clusters whose insertion an element maps to, with the columns of ``CLUSTER_ROW``.

    ``clusters`` has tid and cluster_idx, and all columns but id and assembled.
    """
    rows = clusters.filter(has_any(F.col("flag"), MAPPED))
    made = {"id": cluster_key(F.col("tid"), F.col("cluster_idx")), "assembled": has_any(F.col("flag"), ASSEMBLED).cast("int")}
    return rows.withColumns(made).select(*CLUSTER_ROW)


def write_clusters(clusters: DataFrame, path: str) -> None:
    write_table(cluster_rows(clusters), path)


def write_annotations(strings: DataFrame, path: str) -> None:
    """id, strand, class, regions and sources of each cluster."""
    write_table(strings.select("id", "strand", "class", "regions", "sources"), path)


def write_raw(df: DataFrame, path: str) -> None:
    """All columns with their types, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def development_rows(clusters: DataFrame, segments: DataFrame, *, min_overhang: int = 200) -> tuple[DataFrame, DataFrame]:
    """(clusters, anchored segments) of the development version, a line each.

    Clusters: chromosome, the given columns of ``clusters`` behind tid and cluster_idx,
    with id, number of segments and direction (1 is ``+``, 2 is ``-``, else ``*``) put
    in before the third.  Segments: chromosome, cluster id, position, read.
    """
    key = cluster_key(F.col("tid"), F.col("cluster_idx"))
    rest = [c for c in clusters.columns if c not in ("chrom", "tid", "cluster_idx")]
    sign = F.when(F.col("direction") == 1, "+").when(F.col("direction") == 2, "-").otherwise("*")
    parts = ["chrom", *rest[:2], key, "num_seg", sign, *rest[2:]]
    rows = clusters.select("tid", "cluster_idx", F.concat_ws("\t", *parts).alias("line"))
    good = segments.filter(F.col("overhang") >= min_overhang)
    return rows, good.select("tid", "cluster_idx", F.concat_ws("\t", "chrom", key, "ref_pos", "qname").alias("line"))


#: The columns of the first generation's result, in order.
LEGACY_ROW = (
    "chrom", "start", "end", "te", "frequency", "orient", "supporting", "divergence", "method", "origin", "tsd", "inserted", "consensus", "kinds", "te_size", "state",
)


def legacy_bed(clusters: DataFrame) -> DataFrame:
    """The first generation's rows: breakpoints counted from 1, and whether an insertion is somatic and nested."""
    one = clusters.withColumns(
        {
            "start": F.col("bp_start") + 1,
            "end": F.col("bp_end") + 1,
            "origin": origin_label(F.col("n_segments"), F.col("frequency"), F.col("n_unsupp"), F.split_part("kinds", F.lit("_"), F.lit(1)).cast("int"), F.col("n_te")),
        }
    )
    return one.select(*LEGACY_ROW)
