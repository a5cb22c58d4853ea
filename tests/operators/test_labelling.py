from __future__ import annotations

import random

from pyspark.sql import functions as F

from gapline.ext import DEFAULT_SCORER, GreedyAssembler, KmerAligner
from gapline.functions.names import parse_steps, read_origin
from gapline.operators import clusters, label, legacy, simulate
from gapline.operators.dsl import resolve_table
from gapline.operators.intervals import overlap_join
from gapline.plans import caller
from gapline.streaming.sessions import sessions


def test_classify(spark):
    cand = spark.createDataFrame([(1, "c", 100, 110), (2, "c", 300, 310), (3, "c", 800, 810), (4, "d", 100, 110)], "cand_id int, chrom string, start int, end int")
    truth = spark.createDataFrame([("c", 159, 160, "a"), ("c", 290, 291, "b"), ("c", 320, 321, "e"), ("c", 860, 861, "f")], "chrom string, t_start int, t_end int, t_id string")
    got = {r.cand_id: (r.label, r.n_truth, r.truth_id) for r in label.classify(cand, truth).collect()}
    assert got == {1: ("TP", 1, "a"), 2: ("Special", 2, "e"), 3: ("FP", 0, None), 4: ("FP", 0, None)}


def test_carriers_and_support(spark):
    matrix = spark.createDataFrame([(10, "a * a", 1)], "pos int, cells string, part int")
    assert label.carriers(matrix, order="part", sub=50).first().hgs == [50, 52]
    reads = spark.createDataFrame([("c", 0, 100, "r1", "c", 50), ("c", 0, 100, "r2", "c", 51), ("c", 0, 100, "r3", "d", 50)], "chrom string, start int, end int, qname string, origin_chrom string, hg int")
    ins = spark.createDataFrame([("c", 10, 11, "i")], "chrom string, i_start int, i_end int, ins_id string")
    own = spark.createDataFrame([("i", 50), ("i", 52)], "ins_id string, hg int")
    got = {r.qname: r.supports for r in label.support(reads, ins, own).collect()}
    assert got == {"r1": True, "r2": False, "r3": False}
    cand = spark.createDataFrame([(1, "TP"), (2, "TP"), (3, "FP")], "cand_id int, label string")
    sup = spark.createDataFrame([(1, True), (1, False), (2, False)], "cand_id int, supports boolean")
    assert {r.cand_id: r.label for r in label.demote(cand, sup).collect()} == {1: "TP", 2: "FP", 3: "FP"}
    a, b = label.split_by(cand, sup, "cand_id")
    assert (a.count(), b.count()) == (2, 1)


def test_read_names(spark):
    df = spark.createDataFrame([("7;chr2_hg13:900",), ("x",)], "n string")
    got = [tuple(r[0]) for r in df.select(read_origin(F.col("n"))).collect()]
    assert got == [(7, "chr2", 13, 900), (None, None, None, None)]
    steps = spark.range(1).select(parse_steps(F.lit("1:2,2:3"))).first()[0]
    assert [tuple(x) for x in steps] == [(1, 2), (2, 3)]


def test_seed_windows_equal_a_loop(spark):
    rng = random.Random(1)
    rows = sorted({(rng.randint(0, 1), rng.randint(0, 3000)) for _ in range(150)})
    df = spark.createDataFrame(rows, "tid int, pos int")
    got, tiled = ({(r.tid, r.pos): list(r.windows) for r in legacy.seed_windows(df, tile=n).collect()} for n in (1 << 20, 402))
    assert got == tiled
    for t in (0, 1):
        seeds = []
        for _, p in [r for r in rows if r[0] == t]:
            own = [s for s in seeds if s - 200 <= p + 1 and s + 200 >= p - 1]
            if not own:
                own = [p]
                seeds.append(p)
            assert got[t, p] == own


def test_seed_windows_of_ties_gaps_and_nulls(spark):
    rows = [(1, 5), (1, 5), (1, 206), (1, 207), (1, 90_000), (1, -3), (None, 5), (1, None)]
    made = legacy.seed_windows(spark.createDataFrame(rows, "tid int, pos int"), tile=402)
    got = sorted((r.tid or 0, -9 if r.pos is None else r.pos, r.windows) for r in made.collect())
    assert got == [(0, 5, [5]), (1, -9, None), (1, -3, [-3]), (1, 5, [-3]), (1, 5, [-3]), (1, 206, [206]), (1, 207, [206]), (1, 90_000, [90_000])]
    assert legacy.seed_windows(spark.createDataFrame([], "tid int, pos int")).collect() == []


def test_sessions_in_batch_and_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in sessions(df).collect()) == [1, 1, 2]
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    run = sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("sessions_out").count() <= 3


def test_simulators_are_seeded_and_in_bounds(spark):
    contigs = spark.createDataFrame([(0, "c0", 5000), (1, "c1", 3000)], "tid int, chrom string, length int")
    assert [r.n for r in simulate.allocate(contigs, 11).orderBy("tid").collect()] == [6, 5]
    make = lambda seed: simulate.landscape(contigs, 2, seed=seed, germline=6, somatic_per_genome=1, genomes=4, te_length=300)
    first = make(1).orderBy("chrom", "pos").collect()
    assert first == make(1).orderBy("chrom", "pos").collect()
    assert len(first) == 10 and first != make(2).orderBy("chrom", "pos").collect()
    assert all(0 < r.pos <= {"c0": 5000, "c1": 3000}[r.chrom] for r in first)
    assert sum(r.kind == "germline" for r in first) == 6
    assert simulate.target_reads("c", 2.0, genome=1000, read_length=100) == 20
    assert simulate.target_reads("pc", 2.0, genome=1000, read_length=100, pairs=True, inner=50) == 8


def test_allocation_of_long_contigs(spark):
    """The product of total and length is beyond 32 bits; the lengths are not."""
    contigs = spark.createDataFrame([(0, "a", 2_000_000), (1, "b", 2_000_000)], "tid int, chrom string, length int")
    assert [r.n for r in simulate.allocate(contigs, 1500).orderBy("tid").collect()] == [750, 750]
    assert simulate.landscape(contigs, 5, seed=7, germline=500, somatic_per_genome=20, genomes=50).count() == 1500


def test_closed_loop_finds_every_insertion(spark):
    """Simulate, place reads at their true places, call and label: all insertions are found."""
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    chassis = spark.createDataFrame([("c0", dna(30_000))], "chrom string, seq string")
    rows = [("c0", p, f"i{p}", '$1+ 6bp') for p in (5_000, 12_000, 21_000)]
    ins = spark.createDataFrame(rows, "chrom string, pos int, ins_id string, definition string")
    te = dna(400)
    resolved = resolve_table(ins.select("ins_id", F.array(F.lit(te)).alias("base_seqs"), F.array().cast("array<string>").alias("definitions"), F.col("definition").alias("query")))
    carried = ins.select("ins_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("hg"))
    genomes = simulate.build_genomes(chassis, ins, carried, resolved, genomes=2)
    assert {len(r.seq) for r in genomes.collect()} == {30_000 + 3 * 406}
    # a read that spans an insertion aligns as match, insert, match
    aln = ins.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        F.xxhash64("ins_id", "k").alias("aln_id"), F.lit(0).alias("tid"), (F.col("pos") - 1000 - F.col("k") * 10).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.lit(0).alias("flag"),
        F.concat(F.lit("r"), F.col("k"), F.col("ins_id")).alias("qname"), F.concat((1000 + F.col("k") * 10).cast("string"), F.lit("M406I1000M")).alias("cigar"),
    )
    segments = caller.find_segments(aln)
    assert segments.count() == 15
    hits = segments.select("seg_id", F.lit(1).alias("hit_id"), F.lit(0).alias("query_start"), F.lit(400).alias("query_end"), F.lit(0.01).alias("divergence"), F.lit(400).alias("score"), F.lit(400).alias("map_len"))
    none = spark.createDataFrame([], "tid int, i_start int, i_end int")
    stats = spark.createDataFrame([(0.1, 5.0, 2000.0)], "bg_div double, bg_depth double, bg_read_len double")
    called = caller.call(aln, hits, none, none, none, stats, DEFAULT_SCORER)
    found = called.filter("high_quality").select(F.concat_ws("-", "tid", "cluster_idx").alias("cand_id"), F.lit("c0").alias("chrom"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    truth = ins.select("chrom", F.col("pos").alias("t_start"), (F.col("pos") + 1).alias("t_end"), F.col("ins_id").alias("t_id"))
    assert sorted((r.label, r.truth_id) for r in label.classify(found, truth).collect()) == [("TP", "i12000"), ("TP", "i21000"), ("TP", "i5000")]
    assert clusters.breakpoint_mode(caller.find_clusters(segments), key=["tid", "cluster_idx"]).count() == 3


def test_aligner_and_assembler(spark):
    rng = random.Random(3)
    te = "".join(rng.choice("ACGT") for _ in range(300))
    flip = te[::-1].translate(str.maketrans("ACGT", "TGCA"))
    queries = spark.createDataFrame([("q1", "TTTT" + te[50:200]), ("q2", flip[:100])], "id string, seq string")
    targets = spark.createDataFrame([("t", te)], "id string, seq string")
    got = {r.query_id: r for r in KmerAligner().align(queries, targets).collect()}
    assert (got["q1"].query_start, got["q1"].query_end, got["q1"].ref_start, got["q1"].ref_end, got["q1"].reverse) == (4, 154, 50, 200, False)
    assert (got["q2"].query_start, got["q2"].query_end, got["q2"].ref_start, got["q2"].ref_end, got["q2"].reverse) == (0, 100, 200, 300, True)
    reads = spark.createDataFrame([(1, te[a : a + 120]) for a in (0, 60, 120, 180)] + [(2, "ACGT")], "cluster_id int, seq string")
    contigs = {r.cluster_id: r.seq for r in GreedyAssembler().assemble(reads).collect()}
    assert contigs == {1: te, 2: "ACGT"}


def test_left_join_keeps_rows_without_partner(spark):
    a = spark.createDataFrame([(1, "c", 5, 9)], "k int, chrom string, s int, e int")
    b = spark.createDataFrame([("c", 90, 99)], "chrom string, bs int, be int")
    assert overlap_join(a, b, chrom="chrom", left_start=F.col("s"), left_end=F.col("e"), right_start="bs", right_end="be", how="left").count() == 1


def test_labels_equal_all_pairs_without_making_them(spark):
    """Windows and truths over several tiles, equal starts, nested truths, rows without a place."""
    import random

    rng = random.Random(5)
    size = lambda: rng.choice([0, 1, 40, 300, 20_000])
    cands = [(k, rng.choice("ab"), at := rng.randint(0, 40_000), at + size()) for k in range(400)] + [(900, None, 5, 9), (901, "a", None, None)]
    truth = [(k, rng.choice("ab"), at := rng.randint(0, 400) * 100, at + size()) for k in range(300)]
    a = spark.createDataFrame(cands, "cand_id int, chrom string, start int, end int")
    b = spark.createDataFrame(truth, "t_id int, chrom string, t_start int, t_end int")
    made = label.classify(a, b)
    got = {r.cand_id: (r.n_truth, r.truth_id) for r in made.collect()}
    want = {}
    for k, c, s, e in cands:
        met = [(x, y, t) for t, d, x, y in truth if c == d and s is not None and x < e + 50 and y > max(0, s - 50)]
        want[k] = (len(met), max(met)[2] if met else None)
    assert got == want
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_reads_and_insertions_are_not_joined_again(spark):
    reads = spark.createDataFrame([("c", 100, 200, "r", "c", 3), ("c", 100, 200, "q", "c", 4)], "chrom string, start int, end int, qname string, origin_chrom string, hg int")
    insertions = spark.createDataFrame([("c", 150, 151, 1), ("c", 160, 161, 2)], "chrom string, i_start int, i_end int, ins_id int")
    carriers = spark.createDataFrame([(1, 3), (1, 3), (1, 5)], "ins_id int, hg int")
    made = label.support(reads, insertions, carriers)
    assert sorted((r.qname, r.ins_id, r.supports) for r in made.collect()) == [("q", 1, False), ("q", 2, False), ("r", 1, True), ("r", 2, False)]
    top = made._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert "__bin" in top
