"""Queries on single steps of annotation, read-out, labelling and the first generation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline import sql
from gapline.functions import cigar as C
from gapline.functions import flags as B
from gapline.functions import names, sequences
from gapline.operators import annotate, consensus, intervals, label, legacy, popgen, readout, simulate
from gapline.plans.annotation import annotate_insertions, unsent
from gapline.plans.population import SITE_SQL, _sites
from gapline.plans.registry import query, six
from gapline.plans.views import view
from gapline.sources import scratch
from gapline.streaming.sessions import sessions

# --- annotation -----------------------------------------------------------------------


@query("""
WITH g AS (SELECT seg_id AS cluster_id, hit_id, te_tid AS tid, te_tid % 2 = 0 AS is_left, query_start AS s, query_end AS e, CAST(score % 40 AS INT) AS fc, CAST(map_len % 30 AS INT) AS lc
  FROM {hit} WHERE score % 5 > 0 AND NOT reverse),
l AS (SELECT * FROM g WHERE is_left QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY lc, hit_id DESC) = 1),
r AS (SELECT * FROM g WHERE NOT is_left QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY fc, hit_id DESC) = 1)
SELECT cluster_id, coalesce(l.tid, -1) AS tid1, coalesce(l.e, 0) AS left_most, coalesce(l.fc, 0) AS outer1, coalesce(r.tid, -1) AS tid2, coalesce(r.s, 0) AS right_most, coalesce(r.lc, 0) AS outer2
FROM (SELECT DISTINCT cluster_id FROM g) k LEFT JOIN l USING (cluster_id) LEFT JOIN r USING (cluster_id)""")
def flank_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.choose_flanks(_flank_hits(spark, sf_dir))


def _flank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "hit").select(
        F.col("seg_id").alias("cluster_id"), F.col("te_tid").alias("tid"), (F.col("te_tid") % 2 == 0).alias("is_left"), "reverse", (F.col("score") % 5 > 0).alias("valid"),
        F.col("hit_id").alias("ordinal"), F.col("query_start").alias("start"), F.col("query_end").alias("end"), (F.col("score") % 40).alias("first_clip"), (F.col("map_len") % 30).alias("last_clip"),
    )


@query("""
WITH c AS (SELECT cluster_id, flag % 600 AS le, flag % 590 AS rs, flag % 70 AS lo, flag % 60 AS ro, 500 + flag % 100 AS s, 520 + flag % 90 AS e, flag % 80 AS ls FROM {clt})
SELECT cluster_id, le <> 0 AND rs <> 0 AND lo <= 50 AND ro <= 50 AND least(abs(le + ls - s), abs(le + ls - e)) <= 50 AND least(abs(rs + ls - s), abs(rs + ls - e)) <= 50 AND abs(rs - le) <= 50 AS extends FROM c""")
def flank_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flag")
    made = annotate.can_extend(f % 600, f % 590, f % 70, f % 60, 500 + f % 100, 520 + f % 90, f % 80)
    return view(spark, sf_dir, "clt").select("cluster_id", made.alias("extends"))


#: The flank bits that documents stand for, and where their flanks end.
_DOC_SQL = """
d AS (SELECT doc_id, seq AS s1, reverse(seq) AS s2, CAST(doc_id % 50 AS INT) AS l, CAST(60 + doc_id % 40 AS INT) AS r, [4, 8, 16, 32, 0][CAST(doc_id % 5 + 1 AS INT)] AS f, doc_id % 3 = 0 AS dup FROM {dna})"""


def _contigs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    k = F.col("doc_id")
    flag = F.element_at(F.array(*[F.lit(x) for x in (4, 8, 16, 32, 0)]), (k % 5 + 1).cast("int"))
    rows = view(spark, sf_dir, "dna").withColumn("flag", flag + F.when(k % 3 == 0, B.TSD).otherwise(0))
    return rows, [F.col("flag"), F.col("seq"), (k % 50).cast("int"), F.reverse("seq"), (60 + k % 40).cast("int")]


@query(f"""
WITH {_DOC_SQL}
SELECT doc_id, CASE f WHEN 4 THEN substr(s1, l + 1) WHEN 8 THEN substr(s2, 1, r) WHEN 32 THEN substr(s1, l + 1, r - l) WHEN 16 THEN concat(substr(s1, l + 1), repeat('N', 500), substr(s2, 1, r)) END AS ins FROM d""")
def insertion_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts = _contigs(spark, sf_dir)
    return rows.select("doc_id", annotate.insertion_sequence(*parts).alias("ins"))


@query(f"""
WITH {_DOC_SQL}
SELECT doc_id, CASE WHEN dup THEN substr(s1, 11, 12) ELSE '.' END AS tsd,
  CASE f WHEN 4 THEN concat(substr(s1, l + 1), repeat('N', 50)) WHEN 8 THEN concat(repeat('N', 50), substr(s2, 1, r)) WHEN 32 THEN substr(s1, l + 1, r - l)
    WHEN 16 THEN concat(substr(s1, l + 1), repeat('N', 500), substr(s2, 1, r)) END AS ins,
  CASE f WHEN 8 THEN '.' ELSE substr(s1, 1, l) END AS up, CASE f WHEN 4 THEN '.' ELSE substr(s2, r + 1, 500) END AS down FROM d""")
def output_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, (flag, s1, l, s2, r) = _contigs(spark, sf_dir)
    made = annotate.output_sequences(flag, s1, F.lit(10), F.lit(22), s1, l, s2, r)
    return rows.select("doc_id", made["tsd"].alias("tsd"), made["ins"].alias("ins"), made["left"].alias("up"), made["right"].alias("down"))


@query("""
SELECT cluster_id, greatest(0, s - 500) AS left_start, s AS left_end, e AS right_start, least(90000, e + 500) AS right_end
FROM (SELECT cluster_id, CAST(flag % 90000 AS INT) AS s, CAST(flag % 90000 + flag % 40 AS INT) AS e FROM {clt})""")
def flank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("flag") % 90000).cast("int")
    w = annotate.flank_windows(s, s + (F.col("flag") % 40).cast("int"), F.lit(90000))
    return view(spark, sf_dir, "clt").select("cluster_id", *[w[c].alias(c) for c in ("left_start", "left_end", "right_start", "right_end")])


@query("""
SELECT hit_id, 32768 | CASE WHEN query_start < least(floor(len * 0.08), 100) THEN 512 ELSE 0 END | CASE WHEN len - query_end < least(floor(len * 0.08), 100) THEN 1024 ELSE 0 END AS flag
FROM (SELECT *, 300 + score * 3 AS len FROM {hit})""")
def hit_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = annotate.hit_flag(F.col("query_start"), F.col("query_end"), 300 + F.col("score") * 3, F.lit(B.LINE))
    return view(spark, sf_dir, "hit").select("hit_id", made.alias("flag"))


@query("""
SELECT seg_id AS cluster_id, 64 | CASE WHEN count(*) = 1 THEN 8192 ELSE 0 END | CASE WHEN bool_or(te_tid = seg_id % 7) THEN 16384 ELSE 0 END AS hit_flag,
  min(query_start) AS first_start, max(query_end) AS last_end FROM {hit} GROUP BY seg_id""")
def cluster_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "hit").select(F.col("seg_id").alias("cluster_id"), F.col("te_tid").alias("tid"), (F.col("seg_id") % 7).cast("int").alias("rep_tid"), "query_start", "query_end")
    return annotate.cluster_hit_flag(rows)


@query("""
WITH h AS (SELECT seg_id AS cluster_id, hit_id, te_tid % 2 = 0 AS is_left, query_start AS s, query_end AS e, score % 30 AS fc, map_len % 35 AS lc FROM {hit} WHERE score % 5 > 0 AND NOT reverse),
l AS (SELECT cluster_id, arg_max(e, hit_id) AS left_end FROM h WHERE is_left AND abs(e - 450) <= 50 AND fc <= 20 GROUP BY cluster_id),
r AS (SELECT cluster_id, arg_max(s, hit_id) AS right_start FROM h WHERE NOT is_left AND abs(s - 450) <= 50 AND lc <= 20 GROUP BY cluster_id)
SELECT cluster_id, left_end, right_start FROM (SELECT DISTINCT seg_id AS cluster_id FROM {hit}) k LEFT JOIN l USING (cluster_id) LEFT JOIN r USING (cluster_id)""")
def tsd_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flank_hits(spark, sf_dir).withColumns(
        {"first_clip": F.col("first_clip") * 0 + F.col("ordinal") * 0, "ref_start": F.lit(1440), "ref_end": F.lit(1461), "local_start": F.lit(1000)}
    )
    score = view(spark, sf_dir, "hit").select(F.col("hit_id").alias("ordinal"), (F.col("score") % 30).alias("fc"), (F.col("map_len") % 35).alias("lc"))
    rows = rows.join(score, "ordinal").withColumns({"first_clip": F.col("fc"), "last_clip": F.col("lc")})
    return annotate.choose_tsd_hits(rows)


@query("""
SELECT cluster_id, CASE WHEN c[3] - c[2] > 30 THEN 'too_long' ELSE concat(c[2], '-', c[3]) END AS tsd
FROM (SELECT cluster_id, list_sort([flag % 90, flag % 70, flag % 50, flag % 110]) AS c FROM {clt})""")
def legacy_tsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flag")
    return view(spark, sf_dir, "clt").select("cluster_id", annotate.legacy_tsd(F.array(f % 90, f % 70, f % 50, f % 110)).alias("tsd"))


@query("""
WITH a AS (SELECT cluster_id, tid, query_start AS s, query_end AS e, reverse, ref_start AS rs, ref_end AS re, CASE WHEN tid >= 0 THEN 32768 | CASE WHEN ref_start < 48 THEN 512 ELSE 0 END | CASE WHEN ref_end > 552 THEN 1024 ELSE 0 END ELSE 0 END AS f,
    CASE WHEN tid >= 0 THEN 600 END AS len, CASE WHEN tid >= 0 THEN CASE WHEN tid % 2 = 0 THEN 32768 ELSE 262144 END END AS cls FROM {ann}),
o AS (SELECT *, row_number() OVER w AS up, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, e DESC, tid DESC, reverse DESC, rs DESC, re DESC) AS down FROM a WINDOW w AS (PARTITION BY cluster_id ORDER BY s, e, tid, reverse, rs, re)),
n AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id),
fi AS (SELECT * FROM o WHERE up = 1), la AS (SELECT * FROM o WHERE down = 1),
le AS (SELECT * FROM o WHERE tid >= 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY up) = 1),
ri AS (SELECT * FROM o WHERE tid >= 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY down) = 1),
pa AS (SELECT * FROM o WHERE tid = -1 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY up) = 1),
pt AS (SELECT * FROM o WHERE tid = -2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY down) = 1),
j AS (SELECT n.cluster_id, n.n, [4, 8, 32][CAST(n.cluster_id % 3 + 1 AS INT)] | 8192 * (n.n = 1)::INT AS flag,
    coalesce(fi.s < greatest(floor(le.len * 0.2), 100), false) AS nl, coalesce(2000 - la.e < greatest(floor(ri.len * 0.2), 100), false) AS nr,
    n.n > 1 AND (coalesce(fi.tid = -2 AND le.f & 1024 <> 0 AND le.s - pt.e < 20 AND fi.s < 100, false) OR coalesce(la.tid = -1 AND ri.f & 1024 <> 0 AND pa.s - ri.e < 20 AND 2000 - la.e < 100, false)) AS poly,
    coalesce((NOT le.reverse AND le.f & 512 <> 0) OR (ri.reverse AND ri.f & 512 <> 0), false) AS f5, coalesce((le.reverse AND le.f & 1024 <> 0) OR (NOT ri.reverse AND ri.f & 1024 <> 0), false) AS f3,
    le.reverse AS lrev, ri.reverse AS rrev, coalesce(CASE WHEN le.re - le.rs > ri.re - ri.rs THEN le.cls ELSE ri.cls END, 0) AS cls,
    le.rs AS lrs, le.re AS lre
  FROM n JOIN fi USING (cluster_id) JOIN la USING (cluster_id) LEFT JOIN le USING (cluster_id) LEFT JOIN ri USING (cluster_id) LEFT JOIN pa USING (cluster_id) LEFT JOIN pt USING (cluster_id)),
k AS (SELECT *, flag | 2097152 * nl::INT | 4194304 * nr::INT | 128 * poly::INT | 512 * f5::INT | 1024 * f3::INT
    | 2048 * coalesce(NOT f5 AND ((NOT lrev AND flag & 8 <> 0) OR (rrev AND flag & 4 <> 0)), false)::INT
    | 4096 * coalesce(NOT f3 AND ((lrev AND flag & 8 <> 0) OR (NOT rrev AND flag & 4 <> 0)), false)::INT | cls AS g FROM j)
SELECT cluster_id, CAST(g | 8388608 * coalesce(g & 270336 = 270336 AND ((lrs <= 20 AND abs(lre - 120) <= 20) OR (abs(lrs - 480) <= 20 AND abs(lre - 600) <= 20)), false)::INT AS INT) AS flag FROM k""")
def structure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits that the order of an insertion's parts implies; without tails beside the insertion."""
    te = F.col("tid") >= 0
    ends = F.when(F.col("ref_start") < 48, B.FULL_5).otherwise(0).bitwiseOR(F.when(F.col("ref_end") > 552, B.FULL_3).otherwise(0))
    parts = view(spark, sf_dir, "ann").withColumns(
        {
            "flag": F.when(te, F.lit(B.LINE).bitwiseOR(ends)).otherwise(0), "te_len": F.when(te, 600), "ltr_len": F.when(te, 120),
            "te_class": F.when(te, F.when(F.col("tid") % 2 == 0, B.LINE).otherwise(B.LTR)),
        }
    )
    flank = F.element_at(F.array(F.lit(B.LEFT_FLANK), F.lit(B.RIGHT_FLANK), F.lit(B.SAME_CONTIG)), (F.col("cluster_id") % 3 + 1).cast("int"))
    rows = parts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("cluster_id", flank.bitwiseOR(F.when(F.col("n") == 1, B.SINGLE).otherwise(0)).alias("flag"), F.lit(2000).alias("ins_len"), F.lit("C" * 20).alias("left_seq"), F.lit("C" * 20).alias("right_seq"))
    return annotate.structure(parts, rows).select("cluster_id", "flag")


@query()
def annotated_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the annotation in one plan; its steps have twins of their own, the whole is tested on cases."""
    k = F.col("cluster_id")
    seq = F.repeat(F.translate(F.upper("p_name"), "BDEFHIJKLMOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTAC"), 30)
    names_ = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("cluster_id"), seq.alias("seq"))
    contigs = names_.select("cluster_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("tid"), "seq")
    rows = view(spark, sf_dir, "clt").join(unsent(names_), "cluster_id").select(
        "cluster_id", F.lit(1).alias("tid"), k.alias("cluster_idx"), F.lit("chr1").alias("chrom"), (k * 10 + 500).cast("int").alias("ref_start"), (k * 10 + 503).cast("int").alias("ref_end"),
        (k * 10).cast("int").alias("local_start"), F.col("seq").alias("local_seq"), F.lit(2).alias("flag"), "clt_type", (k % 7).cast("int").alias("rep_tid"), F.lit(0.9).alias("prob"),
        *[F.lit(n).alias(c) for n, c in enumerate(("n_support", "n_left", "n_span", "n_right"), 1)],
    )
    te = view(spark, sf_dir, "hit").select(
        F.col("seg_id").alias("cluster_id"), F.col("te_tid").alias("tid"), (F.col("query_start") % 300).alias("start"), (F.col("query_start") % 300 + 20).alias("end"), "reverse",
        (F.col("score") % 200).alias("ref_start"), (F.col("score") % 200 + 20).alias("ref_end"),
    )
    kinds = list(B.CLASSES)
    elements = spark.createDataFrame([(t, f"TE{t}", 250 + t, 40, kinds[t % 5]) for t in range(7)], "tid int, te_name string, te_len int, ltr_len int, class string")
    flanks = _flank_hits(spark, sf_dir).withColumns({"start": F.col("start") % 200 + 150, "end": F.col("end") % 100})
    return annotate_insertions(rows, contigs, flanks, te, elements, flanks)


# --- sequences and alignments ---------------------------------------------------------

_OPS = "CAST(pos % 4 AS INT) AS a, CAST(m1 % 7 + 1 AS INT) AS b, CAST(ins % 3 AS INT) AS c, CAST(m2 % 5 + 1 AS INT) AS d, CAST(mapq % 6 AS INT) AS e, CAST(nm % 4 + 1 AS INT) AS f"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").selectExpr("aln_id", "pos", *[e.strip() for e in _OPS.split(", ")])
    parts = [F.concat(F.col(n).cast("string"), F.lit(op)) for n, op in zip("abcdef", "SMIMDM", strict=True)]
    return rows.withColumn("cigar", F.concat(*parts))


@query(f"""
WITH o AS (SELECT aln_id, pos, {_OPS} FROM {{aln}}), t AS (SELECT *, a + b + c + d + f AS q, b + d + e + f AS r FROM o)
SELECT aln_id, q + e AS n, q * (q - 1) // 2 - e AS sum_query, pos::BIGINT * r + r * (r - 1) // 2 - (a + c) AS sum_ref FROM t""")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _short(spark, sf_dir).withColumn("p", C.aligned_pairs(C.parse(F.col("cigar")), F.col("pos")))
    total = lambda c: F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x[c])
    return pairs.select("aln_id", F.size("p").alias("n"), total("query").alias("sum_query"), total("ref").alias("sum_ref"))


@query(f"""
WITH o AS (SELECT aln_id, pos, {_OPS} FROM {{aln}}),
x AS (SELECT aln_id, b + d + e + f AS n, e AS n_del, c AS n_ins FROM o)
SELECT aln_id, CAST(n AS BIGINT) AS n_columns, CAST(n_del AS BIGINT) AS n_deleted, CAST(n_ins AS BIGINT) AS n_inserted FROM x""")
def pileup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, sf_dir).withColumn("seq", F.repeat(F.lit("ACGT"), F.lit(10)))
    made = consensus.pileup_columns(rows, key=["aln_id"], ops=C.parse(F.col("cigar")))
    return made.groupBy("aln_id").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("base") == "").alias("n_deleted"), F.sum(F.char_length("inserted")).cast("bigint").alias("n_inserted")
    )


@query("""
WITH p AS (SELECT seg_id, hit_id, CASE WHEN score % 4 = 0 THEN -1 ELSE query_start END AS q, CASE WHEN score % 5 = 0 THEN -1 ELSE map_len END AS r FROM {hit}),
w AS (SELECT *, last_value(CASE WHEN q >= 0 AND r >= 0 THEN hit_id END IGNORE NULLS) OVER (PARTITION BY seg_id ORDER BY hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  first_value(CASE WHEN q >= 0 AND r >= 0 THEN hit_id END IGNORE NULLS) OVER (PARTITION BY seg_id ORDER BY hit_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM p)
SELECT w.seg_id, w.hit_id, x.q AS before_query, x.r AS before_ref, y.q AS behind_query, y.r AS behind_ref FROM w LEFT JOIN p x ON x.hit_id = w.b AND x.seg_id = w.seg_id LEFT JOIN p y ON y.hit_id = w.a AND y.seg_id = w.seg_id""")
def nearest_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "hit").select(
        "seg_id", "hit_id", F.when(F.col("score") % 4 == 0, -1).otherwise(F.col("query_start")).alias("query"), F.when(F.col("score") % 5 == 0, -1).otherwise(F.col("map_len")).alias("ref")
    )
    made = consensus.nearest_aligned(rows, key=["seg_id"], ordinal="hit_id")
    return made.select("seg_id", "hit_id", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "behind") for c in ("query", "ref")])


@query("""
WITH h AS (SELECT seg_id, score % 3 > 0 AS change, row_number() OVER (PARTITION BY seg_id ORDER BY hit_id) AS k FROM {hit}),
g AS (SELECT *, sum((NOT change)::INT) OVER (PARTITION BY seg_id ORDER BY k) AS run FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY seg_id, run, change ORDER BY k) AS place FROM g)
SELECT seg_id, string_agg(CASE WHEN change AND place % 2 = 1 THEN '1' ELSE '0' END, '' ORDER BY k) AS done FROM r GROUP BY seg_id""")
def skipped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "hit").groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("hit_id", (F.col("score") % 3 > 0).alias("c")))).alias("r"))
    done = consensus.skip_next(F.transform("r", lambda x: x["c"]))
    return rows.select("seg_id", F.array_join(F.transform(done, lambda x: x.cast("int").cast("string")), "").alias("done"))


@query("""
SELECT aln_id, aln_id % 1000 AS counter, concat('chr', tid) AS chrom, CAST(mapq AS INT) AS hg, CAST(pos AS BIGINT) AS pos FROM {aln}""")
def read_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").select("aln_id", F.concat((F.col("aln_id") % 1000).cast("string"), F.lit(";chr"), "tid", F.lit("_hg"), "mapq", F.lit(":"), "pos").alias("name"))
    return rows.select("aln_id", names.read_origin(F.col("name"))["counter"].alias("counter"), *[names.read_origin(F.col("name"))[c].alias(c) for c in ("chrom", "hg", "pos")])


@query("SELECT p_partkey AS id, unnest([1, p_size]) AS first, unnest([CAST(p_partkey % 9 AS INT), 3]) AS second FROM part")
def step_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    steps = names.parse_steps(F.concat(F.lit("1:"), F.col("p_partkey") % 9, F.lit(","), "p_size", F.lit(":3")))
    return rows.select(F.col("p_partkey").alias("id"), F.inline(steps))


@query("SELECT doc_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc, substr(seq, 4, 20) AS part, nullif(replace(seq, 'N', ''), '') AS plain FROM {dna}")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the functions that a session's SQL can call."""
    sql.register(spark, "gap_")
    return view(spark, sf_dir, "dna").selectExpr("doc_id", "gap_reverse_complement(seq) AS rc", "gap_subsequence(seq, 3, 23) AS part", "gap_strip_n(seq) AS plain")


# --- read-out -------------------------------------------------------------------------


@query("SELECT concat('s', doc_id) AS name, substr(seq, CAST(doc_id % 30 + 1 AS INT), CAST(doc_id % 90 AS INT)) AS seq FROM {dna}")
def segment_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") % 30).cast("int")
    rows = view(spark, sf_dir, "dna").select(F.concat(F.lit("s"), "doc_id").alias("seg_id"), "seq", k.alias("query_start"), (k + (F.col("doc_id") % 90).cast("int")).alias("query_end"))
    return readout.segment_sequences(rows)


def _read_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "dna").select(
        F.lit(1).alias("tid"), (F.col("doc_id") % 97).alias("cluster_idx"), F.concat(F.lit("r"), "doc_id").alias("qname"), "seq", F.char_length("seq").alias("read_len"),
        (F.col("doc_id") % 30).cast("int").alias("query_start"), (F.col("doc_id") % 30 + 10).cast("int").alias("query_end"), F.col("doc_id").alias("aln_id"),
        F.lit(0).alias("ref_pos"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("seg_type"),
    )
    found = rows.groupBy("tid", "cluster_idx").agg(F.count(F.lit(1)).alias("num_seg_raw"))
    found = found.withColumns({"high_quality": F.col("cluster_idx") % 2 == 0, "clt_type": F.when(F.col("cluster_idx") % 3 == 0, 0).otherwise(1)})
    return rows, found


_READ_SQL = "r AS (SELECT 1 AS tid, doc_id % 97 AS cluster_idx, concat('r', doc_id) AS qname, seq, length(seq) AS n, CAST(doc_id % 30 AS INT) AS s, CAST(doc_id % 30 + 10 AS INT) AS e, doc_id, doc_id % 4 = 0 AS ins FROM {dna})"


@query(f"""
WITH {_READ_SQL} SELECT tid, cluster_idx, qname, substr(seq, greatest(0, s - 15) + 1, greatest(0, least(n, e + 15) - greatest(0, s - 15))) AS seq FROM r WHERE cluster_idx % 6 = 0""")
def cluster_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readout.cluster_reads(*_read_segments(spark, sf_dir), flank=15)


@query(f"""
WITH {_READ_SQL}, c AS (SELECT cluster_idx FROM r GROUP BY cluster_idx HAVING cluster_idx % 2 = 0 AND count(*) >= 3 AND cluster_idx % 5 > 0)
SELECT tid, cluster_idx, qname, seq FROM r JOIN c USING (cluster_idx) QUALIFY row_number() OVER (PARTITION BY cluster_idx ORDER BY ins DESC, CASE WHEN ins THEN n ELSE 10 END DESC, doc_id) = 1""")
def stand_in_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _read_segments(spark, sf_dir)
    assembled = found.filter("cluster_idx % 5 = 0").select("tid", "cluster_idx")
    return readout.stand_ins(rows, found, assembled, order=("ref_pos", "aln_id"), least=3)


@query(f"WITH {_READ_SQL} SELECT count(DISTINCT cluster_idx) AS n_clusters, count(DISTINCT CASE WHEN cluster_idx % 2 = 0 THEN cluster_idx END) AS n_good, count(*) AS n_segments FROM r")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _read_segments(spark, sf_dir)
    return readout.report(found, rows)


# --- intervals, labels, first generation ----------------------------------------------


@query("""
WITH b AS (SELECT aln_id % 4000 AS c, tid, min(pos) AS s, min(pos) + 30 AS e FROM {aln} GROUP BY ALL),
m AS (SELECT b.c, b.tid, s, e, ivl_id, i_start, i_end, least(abs(s - i_start), abs(s - i_end), abs(e - i_start), abs(e - i_end)) AS d
  FROM b LEFT JOIN {ivl} ON b.tid = ivl.tid AND i_start < e + 50 AND i_end > greatest(0, s - 50))
SELECT c AS cluster_idx, tid, CASE WHEN count(ivl_id) = 0 THEN 1 WHEN min(d) < 50 THEN 2 ELSE 4 END AS location, arg_min(CASE WHEN ivl_id % 3 > 0 THEN ivl_id END, {'a': i_start, 'b': i_end, 'c': ivl_id}) FILTER (ivl_id % 3 > 0) AS rep_id
FROM m GROUP BY c, tid""")
def cluster_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = view(spark, sf_dir, "aln").groupBy((F.col("aln_id") % 4000).alias("cluster_idx"), "tid").agg(F.min("pos").alias("ref_start"), (F.min("pos") + 30).alias("ref_end"))
    known = view(spark, sf_dir, "ivl")
    return intervals.cluster_location(bounds, known.filter("ivl_id % 3 = 0"), known.filter("ivl_id % 3 <> 0"), key=["cluster_idx", "tid"])


@query("SELECT site_id, chrom, pos FROM {site} WHERE chrom IN (1, 3)")
def chromosome_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.of_chromosomes(view(spark, sf_dir, "site"), [1, 3]).select("site_id", "chrom", "pos")


@query(f"""
WITH {SITE_SQL}
SELECT chrom, pos, ref, xcov AS cov, round(xf::DOUBLE / xcov, 6) AS fwd_frac, round(CASE ref WHEN 'A' THEN xa WHEN 'T' THEN xt WHEN 'C' THEN xc ELSE xg END::DOUBLE / xcov, 6) AS ref_frac FROM r WHERE pos % 100 = 1""")
def spaced_snp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popgen.spaced_sites(_sites(spark, sf_dir))
    return rows.select("chrom", "pos", "ref", "cov", six(F.col("fwd_frac"), "fwd_frac"), six(F.col("ref_frac"), "ref_frac"))


@query("""
WITH s AS (SELECT DISTINCT aln_id % 5000 AS cand_id, qname, pos FROM {aln} WHERE mapq > 30), c AS (SELECT DISTINCT cand_id FROM s WHERE cand_id % 3 = 0)
SELECT cand_id, a.aln_id FROM {aln} a JOIN s USING (qname, pos) JOIN c USING (cand_id)""".replace("{aln} a", "(SELECT * FROM {aln}) a"))
def segment_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln")
    segs = rows.filter("mapq > 30").select((F.col("aln_id") % 5000).alias("cand_id"), "qname", "pos")
    return label.segment_reads(segs, segs.filter("cand_id % 3 = 0").select("cand_id").distinct(), rows).select("cand_id", "aln_id")


@query("""
SELECT ivl_id, CASE WHEN ivl_id IN (SELECT aln_id % 40000 FROM {aln}) THEN 'both' ELSE 'one' END AS part FROM {ivl}""")
def split_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = view(spark, sf_dir, "aln").select((F.col("aln_id") % 40000).alias("ivl_id"))
    both, one = label.split_by(view(spark, sf_dir, "ivl"), other, "ivl_id")
    return both.select("ivl_id", F.lit("both").alias("part")).unionByName(one.select("ivl_id", F.lit("one").alias("part")))


@query("""
WITH s AS (SELECT aln_id % 40000 AS cand_id, bool_or(mapq > 30) AS good FROM {aln} GROUP BY ALL)
SELECT ivl_id AS cand_id, CASE WHEN ivl_id % 3 = 0 THEN 'FP' WHEN coalesce(good, false) THEN 'TP' ELSE 'FP' END AS label FROM {ivl} LEFT JOIN s ON cand_id = ivl_id""")
def demoted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ivl").select(F.col("ivl_id").alias("cand_id"), F.when(F.col("ivl_id") % 3 == 0, "FP").otherwise("TP").alias("label"))
    found = view(spark, sf_dir, "aln").select((F.col("aln_id") % 40000).alias("cand_id"), (F.col("mapq") > 30).alias("supports"))
    return label.demote(rows, found)


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "aln").select(
        F.col("tid").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + F.col("m1") + F.col("m2")).alias("end"), "qname", "mapq",
        (F.col("nm").cast("double") / 500).alias("divergence"), (F.col("lc") > 100).alias("left"), (F.col("rc") > 100).alias("right"),
    )
    found = view(spark, sf_dir, "ivl").select(F.col("tid").alias("chrom"), F.col("ivl_id").alias("cluster_id"), F.col("i_start").alias("bp_start"), (F.col("i_start") + 20).alias("bp_end"))
    return rows, found


@query("""
SELECT ivl_id AS cluster_id, count_if(NOT l AND NOT r) AS n_span, count_if(l AND r) AS n_double, count_if(l AND NOT r) AS n_left, count_if(NOT l AND r) AS n_right
FROM {ivl} JOIN (SELECT tid, pos, pos + m1 + m2 AS stop, lc > 100 AS l, rc > 100 AS r FROM {aln}) a ON a.tid = ivl.tid AND i_start < stop AND i_start + 21 > pos GROUP BY ivl_id""")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.region_scan(*_spans(spark, sf_dir))


@query("""
WITH a AS (SELECT tid, pos, pos + m1 + m2 AS stop, qname, mapq, CAST(nm AS DOUBLE) / 500 AS d FROM {aln})
SELECT DISTINCT ivl_id AS cluster_id, qname FROM {ivl} JOIN a ON a.tid = ivl.tid AND pos <= i_start - 30 AND stop >= i_start + 20 + 30 WHERE mapq >= 60 AND d <= 0.1
EXCEPT SELECT aln_id % 15000 AS cluster_id, qname FROM {aln}""")
def non_supporting_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _spans(spark, sf_dir)
    support = view(spark, sf_dir, "aln").select((F.col("aln_id") % 15000).alias("cluster_id"), "qname")
    return legacy.non_supporting(rows, found, support)


@query("SELECT aln_id % 3000 AS cluster_id, min(pos) AS bp_start, max(pos) AS bp_end FROM {aln} GROUP BY ALL")
def legacy_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.breakpoints(view(spark, sf_dir, "aln").withColumn("cluster_id", F.col("aln_id") % 3000))


@query("""
SELECT seg_id % 500 AS cluster_id, concat('r', te_tid) AS qname, any_value(reverse) AS strand, min(query_start) AS query_start, max(query_end) AS query_end, count(*) AS n_segments
FROM {hit} GROUP BY ALL HAVING count(DISTINCT reverse) = 1""".replace("GROUP BY ALL", "GROUP BY seg_id % 500, te_tid"))
def merged_read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "hit").select((F.col("seg_id") % 500).alias("cluster_id"), F.concat(F.lit("r"), "te_tid").alias("qname"), F.col("reverse").alias("strand"), "query_start", "query_end")
    return legacy.merge_read_segments(rows)


@query("""
SELECT aln_id % 3000 AS cluster_id, min(CASE WHEN lc > 100 AND rc > 100 THEN pos END) AS dc_start, max(CASE WHEN lc > 100 AND rc > 100 THEN pos + m1 END) AS dc_end, count_if(lc > 100 AND rc > 100) AS n_double
FROM {aln} GROUP BY ALL""")
def double_clip_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").select(
        (F.col("aln_id") % 3000).alias("cluster_id"), (F.col("lc") > 100).alias("left"), (F.col("rc") > 100).alias("right"), F.col("pos").alias("start"), (F.col("pos") + F.col("m1")).alias("end")
    )
    return legacy.double_clip_region(rows)


@query("""
SELECT ins_id, hg, hg // 10 AS sub_population, hg % 10 AS "column" FROM (SELECT o_orderkey AS ins_id, unnest(range(0, 40)) AS hg FROM orders WHERE o_orderkey % 50 = 0)""".replace(" WHERE o_orderkey % 50 = 0", ""))
def genome_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions of frequency one are in every genome, dealt into sub-populations of ten."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ins_id"), F.lit("germline").alias("kind"), F.lit(1.0).alias("freq"))
    made = simulate.assign_genomes(rows, 40, seed=3, sub=10)
    return made.select("ins_id", F.col("hg").cast("bigint").alias("hg"), F.col("sub_population").cast("bigint").alias("sub_population"), F.col("column").cast("bigint").alias("column"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_sec, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_sec, count(*) AS n FROM s GROUP BY user_id, k""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a real stream of the events, with all of it read, and an end marker that closes the last ones."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, out = scratch.folder(spark, "events"), scratch.folder(spark, "sessions")
    table.write.parquet(f"{source}/a")
    last = table.agg(F.max("ts")).first()[0]
    if last is not None:
        marks = [(-1, last + datetime.timedelta(days=k)) for k in (60, 120)]
        for name, row in zip("bc", marks, strict=True):
            spark.createDataFrame([row], table.schema).coalesce(1).write.parquet(f"{source}/{name}")
    events = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1000).parquet(f"{source}/*")
    made = sessions(events, late="30 days")
    done = made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch.folder(spark, "state")).trigger(availableNow=True).start()
    done.awaitTermination()
    found = spark.read.schema(made.schema).parquet(out).filter("user_id >= 0")
    return found.select("user_id", F.unix_seconds("start").alias("first_sec"), F.unix_seconds("end").alias("last_sec"), "n")


@query("SELECT doc_id, length(seq) > 0 AND length(seq) <= 20 AS short, repeat('N', least(length(seq), 20)) AS mask FROM {dna}")
def masked_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = sequences.mask_ends(F.col("seq"), 10)
    size = F.char_length("seq")
    ends = F.concat(F.left(masked, F.least(size, F.lit(10))), F.right(masked, F.greatest(F.lit(0), F.least(size - 10, F.lit(10)))))
    return view(spark, sf_dir, "dna").select("doc_id", ((size > 0) & (size <= 20)).alias("short"), ends.alias("mask"))
