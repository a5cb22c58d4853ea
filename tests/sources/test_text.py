from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gapline.sources import bam, sinks, text


def put(path, content):
    path.write_text(content)
    return f"file://{path}"


def test_bed(spark, tmp_path):
    rows = text.read_bed(spark, put(tmp_path / "a.bed", "# c\nchr1\t5\t9\tx\nchr1\t9\t5\ty\n\nchr2\t1\t2\n")).collect()
    assert [(r.chrom, r.start, r.end, r.name) for r in rows] == [("chr1", 5, 9, "x"), ("chr2", 1, 2, None)]


def test_sam(spark, tmp_path):
    path = put(tmp_path / "a.sam", "@SQ\tSN:c1\tLN:90\nr1\t16\tc1\t11\t60\t5S10M\t*\t0\t0\tACGTACGTACGTACG\t*\tNM:i:2\tAS:i:9\n")
    row = text.read_sam(spark, path).first()
    assert (row.qname, row.flag, row.pos, row.mapq, row.nm, row.nn, row.score) == ("r1", 16, 10, 60, 2, 0, 9)
    assert [tuple(r) for r in text.read_sam(spark, path, header=True).collect()] == [(0, "c1", 90)]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "GG")], "name string, seq string")
    sinks.write_fasta(df, f"file://{tmp_path}/out", width=4)
    got = text.read_fasta(spark, f"file://{tmp_path}/out", check=True).orderBy("name").collect()
    assert [(r.name, r.seq) for r in got] == [("a", "ACGTACGTAC"), ("b", "GG")]
    with pytest.raises(ValueError):
        text.read_fasta(spark, put(tmp_path / "x.fa", ">a d\nAC\n>a\nGG\n"), check=True)


def test_mpileup(spark, tmp_path):
    path = put(tmp_path / "p", "c\t7\tA\t5\t.,^~T$+2ACg-1Ta\tIIII#\t0\t*\t*\n")
    row = text.read_mpileup(spark, path).first()
    first, second = row.samples
    assert (first.Af, first.Ar, first.Tf, first.Gr) == (1, 2, 1, 1)
    assert sum(second) == 0
    strict = text.read_mpileup(spark, path, min_quality=20).first().samples[0]
    assert (strict.Af, strict.Ar) == (1, 1)


def test_sync(spark, tmp_path):
    df = text.read_strand_sync(spark, put(tmp_path / "s", "#h\nc\t3\tA\t1:2:3:4:5:6:7:8\t0:0:0:0:0:0:0:1\n"))
    sinks.write_strand_sync(df, f"file://{tmp_path}/o")
    assert text.read_strand_sync(spark, f"file://{tmp_path}/o").collect() == df.collect()
    sinks.write_sync(df, f"file://{tmp_path}/q")
    assert spark.read.text(f"file://{tmp_path}/q").first()[0] == "c\t3\tA\t3:7:11:15:0:0\t0:0:0:1:0:0"


def test_pgd(spark, tmp_path):
    path = put(tmp_path / "g", '# c\nchassis="x.fa"\na=$1+2bp # t\n10 a * a\n20 * a *\n')
    chassis, definitions, matrix = text.read_pgd(spark, path)
    assert chassis.first()[0] == "x.fa"
    assert [tuple(r) for r in definitions.collect()] == [("a", "$1+2bp")]
    assert [tuple(r) for r in matrix.orderBy("pos").collect()] == [(10, "a * a"), (20, "* a *")]
    with pytest.raises(Exception, match="width"):
        text.read_pgd(spark, put(tmp_path / "h", "1 a a\n2 a\n"))[2].collect()


def test_small_tables(spark, tmp_path):
    assert text.read_fst(spark, put(tmp_path / "f", "c\t3\t1\t1\t1\t1:2=0.5\t1:3=na\n")).select("first", "second", "value").collect() == [(1, 2, 0.5), (1, 3, None)]
    got = {r.length: r.share for r in text.read_length_histogram(spark, put(tmp_path / "l", "5 1\n7 2\n5 1\n")).collect()}
    assert got == {5: 0.5, 7: 0.5}
    assert text.read_te_sites(spark, put(tmp_path / "t", "9 tsd=4 1 -2 0\n")).first().ids == [1, -2, 0]
    assert text.read_calls(spark, put(tmp_path / "c", "1\t0\tc\t1\tA\t9\tNa\t0.1\t1:2\n1\t1\tc\t2\tA\t9\t0.5\t0.1\t1:2\n")).count() == 1
    assert text.read_truth(spark, put(tmp_path / "i", "c\t1\t2\ti1\td\t+\t0.1\t1\t2\nc\t1\t2\ti2\td\t+\t0.00001\t1\t2\n"), 0.0001).count() == 1


def test_bam(spark, tmp_path):
    records = [{"tid": 0, "qname": f"r{k}", "flag": 0, "pos": k, "mapq": 60, "cigar": [(5, "S"), (3 + k % 4, "M")], "seq": "ACGTN" + "A" * (3 + k % 4), "tags": {"NM": k}} for k in range(3000)]
    (tmp_path / "x.bam").write_bytes(bam.encode([("c1", 99999)], records))
    rows = bam.read_bam(spark, f"file://{tmp_path}/x.bam").orderBy("pos").collect()
    assert [(r.qname, r.rname, r.cigar, r.seq, r.nm) for r in rows] == [(x["qname"], "c1", f"5S{x['cigar'][1][0]}M", x["seq"], x["tags"]["NM"]) for x in records]
    bam.register(spark)
    assert spark.read.format("bam").load(f"{tmp_path}/x.bam").filter(F.col("pos") < 10).count() == 10


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None)], "x string, p double, y int")
    sinks.write_table(df, f"file://{tmp_path}/t")
    assert spark.read.text(f"file://{tmp_path}/t").first()[0] == "a\t0.500000\t."
