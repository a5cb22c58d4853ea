"""Readers of the text formats, as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.arrays import let
from gapline.operators.popgen import FIELDS, SAMPLE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')")


def _field(parts: Column, k: int, kind: str = "string") -> Column:
    return F.try_element_at(parts, F.lit(k)).try_cast(kind)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand; from the third on, missing columns are null.  Rows with start > end go."""
    parts = F.split("value", "\t")
    kinds = {"chrom": "string", "start": "int", "end": "int", "name": "string", "score": "double", "strand": "string"}
    rows = _lines(spark, path).filter("not startswith(value, 'track') and not startswith(value, 'browser')")
    rows = rows.select(*[_field(parts, k, t).alias(c) for k, (c, t) in enumerate(kinds.items(), 1)])
    return rows.filter("start <= end")


def read_sam(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """The eleven columns and the tags NM, nn and AS; with ``header`` the @SQ lines as (tid, name, length)."""
    text = spark.read.text(path)
    if header:
        rows = text.filter("startswith(value, '@SQ')").withColumn("__k", F.monotonically_increasing_id())
        made = rows.select(
            "__k", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("int").alias("length")
        )
        from pyspark.sql import Window

        return made.withColumn("tid", F.row_number().over(Window.orderBy("__k")) - 1).select("tid", "name", "length")
    parts = F.split("value", "\t")
    kinds = {
        "qname": "string", "flag": "int", "rname": "string", "pos": "int", "mapq": "int", "cigar": "string", "rnext": "string",
        "pnext": "int", "tlen": "int", "seq": "string", "qual": "string",
    }
    tag = lambda k: F.nullif(F.regexp_extract("value", f"\t{k}:i:(-?[0-9]+)", 1), F.lit("")).cast("int")
    rows = text.filter("value <> '' and not startswith(value, '@')")
    rows = rows.select(*[_field(parts, k, t).alias(c) for k, (c, t) in enumerate(kinds.items(), 1)], tag("NM").alias("nm"), tag("nn").alias("nn"), tag("AS").alias("score"))
    return rows.withColumns({"pos": F.col("pos") - 1, "nn": F.coalesce("nn", F.lit(0))})


def read_fasta(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """(name, description, seq), a record a row; ``check`` raises for repeated names."""
    text = spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.substr("value", F.char_length(head) + 1), r"\s+", "")
    rows = text.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_extract(head, r"^\S+\s+(.*?)\s*$", 1).alias("description"), body.alias("seq"))
    if check:
        again = rows.groupBy("name").count().filter("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"the sequence name {again[0]['name']!r} is repeated")
    return rows


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return _lines(spark, path).select(_field(parts, 1).alias("name"), _field(parts, 2, "int").alias("length"))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(name, class) of elements."""
    parts = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select(_field(parts, 1).alias("name"), F.upper(_field(parts, 2)).alias("class"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """One number a line, numbered from 0 within the file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("tid", "size"))
    return rows.select("tid", F.col("size").try_cast("int").alias("size"))


_INDEL = r"[+-][0-9]+"


def pileup_bases(ref: Column, text: Column) -> Column:
    """The bases of a pileup string: ``.`` and ``,`` are the reference by strand; read starts, ends and indels go."""
    plain = F.replace(F.regexp_replace(text, r"\^.", ""), F.lit("$"), F.lit(""))
    # an indel's number tells how many bases to skip, so the string is cut there and each piece shortened
    sizes = F.transform(F.regexp_extract_all(plain, F.lit(r"[+-]([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    parts = F.split(plain, _INDEL, -1)
    rest = F.zip_with(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), sizes, lambda p, n: F.substr(p, n + 1))
    kept = F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
    up, low = F.upper(ref), F.lower(ref)
    return F.replace(F.replace(kept, F.lit("."), up), F.lit(","), low)


def base_counts(bases: Column, quals: Column, min_quality: int = 0) -> Column:
    """Strand-specific counts of the bases whose quality is high enough."""
    taken = lambda b, q: F.when(F.ascii(q) - 33 >= min_quality, b).otherwise("")
    good = F.array_join(F.zip_with(F.split(bases, ""), F.split(quals, ""), taken), "")

    def counts(found: Column) -> Column:
        count = lambda c: F.char_length(found) - F.char_length(F.replace(found, F.lit(c), F.lit("")))
        return F.struct(*[count(k[0] if k[1] == "f" else k[0].lower()).cast("bigint").alias(k) for k in FIELDS])

    return let(good, counts)


def read_mpileup(spark: SparkSession, path: str, min_quality: int = 0) -> DataFrame:
    """(chrom, pos, ref, samples) of groups of coverage, bases and qualities."""
    parts = F.split("value", "\t")
    groups = F.floor((F.size(parts) - 3) / 3).cast("int")
    rows = _lines(spark, path).withColumn("__p", parts)
    p, ref = F.col("__p"), F.element_at("__p", 3)

    def sample(k: Column) -> Column:
        bases, quals = F.element_at(p, 3 * k + 5), F.element_at(p, 3 * k + 6)
        empty = (F.element_at(p, 3 * k + 4) == "0") | (quals == "*") & (bases == "*")
        return base_counts(F.when(empty, "").otherwise(pileup_bases(ref, bases)), F.when(empty, "").otherwise(quals), min_quality)

    samples = F.transform(F.sequence(F.lit(0), groups - 1), sample)
    return rows.select(_field(p, 1).alias("chrom"), _field(p, 2, "int").alias("pos"), ref.alias("ref"), samples.cast(f"array<{SAMPLE}>").alias("samples"))


def read_strand_sync(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, samples) of ``A:a:T:t:C:c:G:g`` columns."""
    parts = F.split("value", "\t")

    def sample(text: Column) -> Column:
        n = F.split(text, ":")
        return F.struct(*[F.element_at(n, k).cast("bigint").alias(f) for k, f in enumerate(FIELDS, 1)])

    samples = F.transform(F.slice(parts, 4, F.size(parts) - 3), sample)
    return _lines(spark, path).select(_field(parts, 1).alias("chrom"), _field(parts, 2, "int").alias("pos"), _field(parts, 3).alias("ref"), samples.alias("samples"))


def read_fst(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, first, second, value), a row for each ``i:j=value``."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).select(_field(parts, 1).alias("chrom"), _field(parts, 2, "int").alias("pos"), F.explode(F.slice(parts, 6, F.greatest(F.lit(0), F.size(parts) - 5))).alias("p"))
    got = lambda k: F.regexp_extract("p", r"^([0-9]+):([0-9]+)=(.+)$", k)
    return rows.select("chrom", "pos", got(1).try_cast("int").alias("first"), got(2).try_cast("int").alias("second"), got(3).try_cast("double").alias("value"))


def read_measure(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, value): the first two columns and the last."""
    parts = F.split("value", "\t")
    return _lines(spark, path).select(_field(parts, 1).alias("chrom"), _field(parts, 2, "int").alias("pos"), _field(parts, -1, "double").alias("value"))


def read_multimeasure(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    truth = lambda k: F.lower(_field(parts, k)).isin("1", "true", "yes")
    return _lines(spark, path).select(
        _field(parts, 1).alias("chrom"), _field(parts, 2, "int").alias("pos"), truth(3).alias("is_snp"), truth(4).alias("is_outlier"),
        _field(parts, 5, "double").alias("strand_bias"), _field(parts, 6, "double").alias("measure"),
    )


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """SNP calls; rows with an unknown share are skipped."""
    parts = F.split("value", "\t")
    truth = lambda k: F.lower(_field(parts, k)).isin("1", "true")
    rows = _lines(spark, path).select(
        truth(1).alias("simulated"), truth(2).alias("polymorphic"), _field(parts, 3).alias("chrom"), _field(parts, 4, "int").alias("pos"),
        _field(parts, 5).alias("ref"), _field(parts, 6, "int").alias("cov"), _field(parts, 7, "double").alias("fwd_frac"),
        _field(parts, 8, "double").alias("ref_frac"), _field(parts, 9).alias("counts"),
    )
    return rows.filter("fwd_frac is not null and ref_frac is not null")


def read_pgd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A population genome definition: (chassis), (name, expression), (pos, cells).

    Rows of unequal width raise when they are read.
    """
    plain = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(plain.alias("line")).filter("line <> ''")
    named = F.regexp_extract("line", r"^([^=\s]+)\s*=\s*(.+)$", 1)
    value = F.regexp_extract("line", r"^([^=\s]+)\s*=\s*(.+)$", 2)
    chassis = rows.filter(named == "chassis").select(F.trim(F.replace(value, F.lit('"'), F.lit(""))).alias("chassis"))
    definitions = rows.filter((named != "") & (named != "chassis")).select(named.alias("name"), value.alias("expression"))
    matrix = rows.filter(named == "").select(
        F.regexp_extract("line", r"^(\S+)", 1).cast("int").alias("pos"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("cells")
    )
    width = F.size(F.split("cells", r"\s+"))
    widths = matrix.agg(F.min(width).alias("low"), F.max(width).alias("high"))
    checked = matrix.crossJoin(F.broadcast(widths)).withColumn(
        "cells", F.when(F.col("low") == F.col("high"), F.col("cells")).otherwise(F.raise_error(F.lit("rows of a genome matrix differ in width")))
    )
    return chassis, definitions, checked.select("pos", "cells")


def read_te_sites(spark: SparkSession, path: str) -> DataFrame:
    """(pos, tsd, ids) of lines ``pos comment ids``; the comment may give ``tsd=``."""
    parts = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select(
        _field(parts, 1, "int").alias("pos"),
        F.coalesce(F.nullif(F.regexp_extract(_field(parts, 2), r"tsd=([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("tsd"),
        F.transform(F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2)), lambda x: x.try_cast("int")).alias("ids"),
    )


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(id, family, order), found by the names in the header."""
    return spark.read.csv(path, sep="\t", header=True).select("id", "family", "order")


def read_length_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(length, share); equal lengths add up."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(_field(parts, 1, "int").alias("length"), _field(parts, 2, "double").alias("n"))
    sums = rows.groupBy("length").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("length", (F.col("n") / F.col("total")).alias("share"))


def read_truth(spark: SparkSession, path: str, min_frequency: float = 0.0) -> DataFrame:
    """Simulated insertions; positions are 1-based in the file and stay so."""
    parts = F.split("value", "\t")
    kinds = {
        "chrom": "string", "l_bp": "int", "r_bp": "int", "ins_id": "string", "definition": "string", "strand": "string", "freq": "double",
        "tsd_start": "int", "tsd_end": "int",
    }
    rows = _lines(spark, path).select(*[_field(parts, k, t).alias(c) for k, (c, t) in enumerate(kinds.items(), 1)])
    return rows.filter(F.col("freq") > min_frequency)


def fetch(rows: DataFrame, chrom: str, start: int, end: int, *, chrom_col: str = "chrom", start_col: str = "start", end_col: str = "end") -> DataFrame:
    """The intervals of a chromosome that meet [start, end); none for one that is not there."""
    return rows.filter((F.col(chrom_col) == chrom) & (F.col(start_col) < end) & (F.col(end_col) > start))
