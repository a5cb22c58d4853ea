from __future__ import annotations

from pyspark.sql import functions as F

from gapline.__main__ import main
from gapline.operators import readout
from gapline.plans import programs


def put(path, content):
    path.write_text(content)
    return f"file://{path}"


def test_snp_and_sync_programs(spark, tmp_path):
    pileup = put(tmp_path / "p", "c\t101\tA\t4\t..TT\tIIII\t4\t.,tT\tIIII\nc\t102\tA\t2\t..\tII\t0\t*\t*\n")
    calls = programs.snp_caller(spark, pileup, f"file://{tmp_path}/calls", least=1).orderBy("pos").collect()
    assert [(r.simulated, r.polymorphic, r.cov, r.ref_frac) for r in calls] == [(True, True, 8, 0.5), (False, False, 2, 1.0)]
    programs.mpileup_to_strand_sync(spark, pileup, f"file://{tmp_path}/ssync")
    programs.strand_sync_to_sync(spark, f"file://{tmp_path}/ssync", f"file://{tmp_path}/sync", min_count=2)
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/sync").collect()] == ["c\t101\tA\t2:2:0:0:0:0\t2:2:0:0:0:0"]
    assert programs.fst_from_strand_sync(spark, f"file://{tmp_path}/ssync", f"file://{tmp_path}/fst", min_count=2).first().value == 0.0
    rows = programs.multimeasure(spark, f"file://{tmp_path}/ssync", f"file://{tmp_path}/mm", bias="maxfraction", measure="fst", outliers=1).collect()
    assert [r.is_outlier for r in rows] == [True]
    assert programs.roc(spark, f"file://{tmp_path}/mm", 1).collect()[0]["rank"] == 1


def test_labelling_programs(spark):
    cand = spark.createDataFrame([("a", "chr1", 100, 110), ("b", "chr1", 500, 510), ("c", "chr1", 900, 910)], "cand_id string, chrom string, start int, end int")
    truth = spark.createDataFrame([("chr1", 104, 105, "t1"), ("chr1", 504, 505, "t2")], "chrom string, t_start int, t_end int, t_id string")
    segs = spark.createDataFrame([("a", "1;chr1_hg3:90", 90), ("b", "2;chr1_hg4:480", 480)], "cand_id string, qname string, pos int")
    alns = segs.select("qname", "pos").withColumn("chrom", F.lit("chr1"))
    own = spark.createDataFrame([("t1", 3), ("t2", 9)], "t_id string, hg int")
    got = {r.cand_id: r.label for r in programs.label_candidates(cand, truth, segs, alns, own).collect()}
    assert got == {"a": "TP", "b": "FP", "c": "FP"}
    ins = spark.createDataFrame([("chr1", 104, 105, "t1", 0.5), ("chr1", 504, 505, "t2", 0.00001)], "chrom string, l_bp int, r_bp int, ins_id string, freq double")
    reads = spark.createDataFrame([("chr1", 90, 600, "1;chr1_hg3:90"), ("chr1", 90, 600, "2;chr1_hg4:90")], "chrom string, start int, end int, qname string")
    sup = programs.label_support(reads, ins, own.withColumnRenamed("t_id", "ins_id")).collect()
    assert {(r.qname, r.ins_id, r.supports) for r in sup} == {("1;chr1_hg3:90", "t1", True), ("2;chr1_hg4:90", "t1", False)}


def test_read_out(spark):
    clusters = spark.createDataFrame([(0, 0, True, 0, 3), (0, 1, True, 1, 1), (0, 2, False, 0, 3)], "tid int, cluster_idx int, high_quality boolean, clt_type int, num_seg_raw int")
    segs = spark.createDataFrame(
        [(0, k, f"q{k}", 2, 4, 10, "ACGTACGTAC", 2, 50, k) for k in range(3)],
        "tid int, cluster_idx int, qname string, query_start int, query_end int, read_len int, seq string, seg_type int, ref_pos int, aln_id int",
    )
    assert [tuple(r) for r in readout.cluster_reads(segs, clusters, flank=1).collect()] == [(0, 0, "q0", "CGTA")]
    done = spark.createDataFrame([(0, 0)], "tid int, cluster_idx int")
    assert [r.qname for r in readout.stand_ins(segs, clusters, done).collect()] == ["q1"]
    assert readout.stand_ins(segs, clusters, done, least=3).count() == 0
    assert readout.segment_sequences(segs.withColumnRenamed("aln_id", "seg_id")).first().seq == "GT"
    assert tuple(readout.report(clusters, segs).first()) == (3, 2, 3)


def test_command_line(spark, tmp_path):
    sam = put(tmp_path / "a.sam", "@SQ\tSN:c1\tLN:9000\n" + "".join(f"r{k}\t0\tc1\t{100 + k}\t60\t300M200I300M\t*\t0\t0\t*\t*\n" for k in range(3)))
    main(["clusters", sam, f"file://{tmp_path}/out"])
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ["c1\t398\t401\t3"]


def folder(spark, path):
    return sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(path).collect())


def test_call_from_alignments_and_hits(spark, tmp_path):
    sam, bed, hits = (tmp_path / n for n in ("a.sam", "none.bed", "hits.tsv"))
    row = "{}\t0\tchr1\t{}\t60\t500M200I400M\t*\t0\t0\t{}\t*\tNM:i:210\tnn:i:10\n"
    sam.write_text("@SQ\tSN:chr1\tLN:100000\n" + "".join(row.format(f"r{k}", 1001 + k, "ACGT" * 275) for k in range(4)) + row.format("far", 50_001, "ACGT" * 275))
    bed.write_text("chr9\t1\t2\n")
    main(["segments", str(sam), f"file://{tmp_path}/segments"])
    names = [x[1:] for x in folder(spark, f"file://{tmp_path}/segments") if x.startswith(">")]
    assert len(names) == 5
    head = "seg_id\thit_id\tquery_start\tquery_end\tmap_len\tscore\tdivergence\n"
    hits.write_text(head + "".join(f"{n}\t{k}\t0\t190\t190\t180\t0.01\n" for k, n in enumerate(names)))
    main(["call", str(sam), str(hits), str(bed), str(bed), str(bed), f"file://{tmp_path}/called"])
    got = [x.split("\t") for x in folder(spark, f"file://{tmp_path}/called")]
    assert sorted((x[0], int(x[1]), int(x[3]), x[-1]) for x in got) == [("chr1", 1499, 4, "true"), ("chr1", 50499, 1, "true")]


def test_label_and_simulate(spark, tmp_path):
    (tmp_path / "c.bed").write_text("chr1\t100\t120\ta\nchr1\t5000\t5010\tb\nchr2\t100\t120\tc\n")
    (tmp_path / "t.bed").write_text("chr1\t110\t111\tx\nchr2\t90\t95\ty\nchr2\t140\t150\tz\n")
    main(["label", f"{tmp_path}/c.bed", f"{tmp_path}/t.bed", f"file://{tmp_path}/labels"])
    found = spark.read.text(f"file://{tmp_path}/labels").collect()
    assert sorted((r.label, r.value.split("\t")[1]) for r in found) == [("FP", "5000"), ("Special", "100"), ("TP", "100")]
    (tmp_path / "g.fa").write_text(">chr1 x\n" + "ACGT" * 500 + "\n>chr2\n" + "GGCC" * 250 + "\n")
    arguments = ["simulate", f"{tmp_path}/g.fa", "--germline", "6", "--somatic", "2", "--genomes", "10", "--sub-population", "5"]
    for run in ("a", "b"):
        main([*arguments[:2], f"file://{tmp_path}/{run}", *arguments[2:]])
    assert folder(spark, f"file://{tmp_path}/a") == folder(spark, f"file://{tmp_path}/b")
    assert len(folder(spark, f"file://{tmp_path}/a/insertions")) == 26
    assert {r.sub_population for r in spark.read.text(f"file://{tmp_path}/a/carriers").collect()} <= {0, 1}
