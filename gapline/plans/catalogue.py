"""Named queries over views of the driver's tables, each beside its SQL twin.

The SQL is written on its own, not derived from the operators: where an operator
walks a CIGAR string, tiles a chromosome or bins an interval, the twin adds up
columns, uses plain windows or joins on ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions import cigar as C
from gapline.functions import flags as B
from gapline.functions import names
from gapline.operators import annotate, clusters, filters, intervals, segments, te_hits
from gapline.plans.caller import locate
from gapline.plans.registry import oracle_sql, queries, query, six
from gapline.plans.views import view

__all__ = ["oracle_sql", "queries"]

# --- alignments and segments ----------------------------------------------------------

SEGMENT_SQL = """
parts AS (
  SELECT *, 1 AS seg_type, 0 AS query_start, lc AS query_end, pos AS ref_pos, m1 + m2 AS overhang FROM {aln} WHERE flag & 260 = 0 AND lc >= 100
  UNION ALL
  SELECT *, 2, lc + m1, lc + m1 + ins, pos + m1, least(m1, m2) FROM {aln} WHERE flag & 260 = 0 AND ins >= 100
  UNION ALL
  SELECT *, 4, lc + m1 + ins + m2, lc + m1 + ins + m2 + rc, pos + m1 + m2, m1 + m2 FROM {aln} WHERE flag & 260 = 0 AND rc >= 100),
seg AS (
  SELECT *, pos + m1 + m2 AS aln_end, m1 + m2 AS match_len, lc + m1 + ins + m2 + rc AS read_len,
         CAST(sum(seg_type) OVER (PARTITION BY aln_id) AS INT) AS aln_type,
         CAST(count(*) OVER (PARTITION BY aln_id) AS INT) AS num_seg,
         CAST(row_number() OVER (PARTITION BY aln_id ORDER BY seg_type) - 1 AS INT) AS seg_order
  FROM parts),
anchored AS (SELECT * FROM seg WHERE overhang >= 200)"""
CLUSTER_SQL = (
    SEGMENT_SQL
    + """,
flagged AS (
  SELECT *, CASE WHEN ref_pos > lag(ref_pos) OVER w + 50 OR lag(ref_pos) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM anchored WINDOW w AS (PARTITION BY tid ORDER BY ref_pos, aln_id, seg_type)),
clu AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY tid ORDER BY ref_pos, aln_id, seg_type) - 1 AS BIGINT) AS cluster_idx FROM flagged)"""
)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.extract_segments(view(spark, sf_dir, "aln"), min_overhang=200)


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_by_gap(_segments(spark, sf_dir), ties=("aln_id", "seg_type"), tile=1 << 16)


@query(f"WITH {SEGMENT_SQL} SELECT aln_id, seg_order, seg_type, query_start, query_end, ref_pos, overhang, aln_end, match_len, read_len, aln_type, num_seg FROM seg")
def segment_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.extract_segments(view(spark, sf_dir, "aln"))
    return rows.select("aln_id", "seg_order", "seg_type", "query_start", "query_end", "ref_pos", "overhang", "aln_end", "match_len", "read_len", "aln_type", "num_seg")


@query("""
SELECT aln_id, m1 + ins + m2 AS map_length, pos + m1 + m2 AS ref_end, lc AS first_clip, rc AS last_clip,
       CASE WHEN flag & 16 <> 0 THEN rc ELSE lc END AS q_start,
       lc + m1 + ins + m2 + rc - CASE WHEN flag & 16 <> 0 THEN lc ELSE rc END AS q_end,
       CAST(nm - 1 AS DOUBLE) / (m1 + ins + m2) AS divergence
FROM {aln}""")
def cigar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").withColumn("ops", C.parse(F.col("cigar")))
    ops, length = F.col("ops"), C.total(F.col("ops"), "MIS=X")
    span = C.query_interval(ops, length, F.col("flag").bitwiseAND(F.lit(16)) != 0)
    return rows.select(
        "aln_id", C.map_length(ops).alias("map_length"), C.reference_end(ops, F.col("pos")).alias("ref_end"), C.clip(ops).alias("first_clip"),
        C.clip(ops, True).alias("last_clip"), span["start"].alias("q_start"), span["end"].alias("q_end"), C.divergence(F.col("nm"), F.lit(1), ops).alias("divergence"),
    )


@query("""
SELECT aln_id, greatest(0, pos - 3000) AS region_start, least(lc + m1 + ins + m2 + rc, pos % 900 + 3100) AS region_end,
       concat_ws('.', qname, tid, 'm') AS label, concat_ws('-', tid, aln_id) AS key
FROM {aln} WHERE flag & 256 = 0 AND mapq > 0""")
def read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").filter(segments.legacy_read_filter(F.col("flag"), F.col("mapq")))
    length = C.total(C.parse(F.col("cigar")), "MIS=X")
    region = segments.trim_region(F.col("pos"), F.col("pos") % 900 + 100, length, 3000)
    label_ = names.segment_name(F.col("qname"), F.concat(F.col("tid").cast("string"), F.lit(".")), kind=F.lit(2))
    return rows.select(
        "aln_id", region["start"].alias("region_start"), region["end"].alias("region_end"), label_.alias("label"), names.cluster_key(F.col("tid"), F.col("aln_id")).alias("key")
    )


# --- clusters -------------------------------------------------------------------------


@query(f"""
WITH {CLUSTER_SQL}
SELECT tid, cluster_idx, min(ref_pos) - 1 AS ref_start, max(ref_pos) AS ref_end, count(*) AS num_seg,
       count(*) FILTER (seg_type = 1) AS num_left, count(*) FILTER (seg_type = 2) AS num_middle, count(*) FILTER (seg_type = 4) AS num_right,
       bit_or(seg_type) AS types
FROM clu GROUP BY tid, cluster_idx""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).groupBy("tid", "cluster_idx").agg(
        (F.min("ref_pos") - 1).alias("ref_start"),
        F.max("ref_pos").alias("ref_end"),
        F.count(F.lit(1)).alias("num_seg"),
        F.count_if(F.col("seg_type") == 1).alias("num_left"),
        F.count_if(F.col("seg_type") == 2).alias("num_middle"),
        F.count_if(F.col("seg_type") == 4).alias("num_right"),
        F.bit_or("seg_type").alias("types"),
    )


@query(f"""
WITH {CLUSTER_SQL},
n AS (SELECT tid, cluster_idx, ref_pos, count(*) AS n FROM clu GROUP BY ALL)
SELECT tid, cluster_idx, ref_pos AS break_pos, n AS n_at_break FROM n
QUALIFY row_number() OVER (PARTITION BY tid, cluster_idx ORDER BY n DESC, ref_pos) = 1""")
def breakpoint_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.breakpoint_mode(_clustered(spark, sf_dir), key=["tid", "cluster_idx"])


@query(f"""
WITH {CLUSTER_SQL}
SELECT tid, cluster_idx, aln_id, seg_type, read_len FROM clu
QUALIFY row_number() OVER (PARTITION BY tid, cluster_idx ORDER BY (seg_type = 2) DESC,
  CASE WHEN seg_type = 2 THEN read_len ELSE query_end - query_start END DESC, ref_pos, aln_id, seg_type) = 1""")
def representative_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.representative(_clustered(spark, sf_dir), key=["tid", "cluster_idx"], order=["ref_pos", "aln_id", "seg_type"])
    return rows.select("tid", "cluster_idx", "aln_id", "seg_type", "read_len")


@query(f"""
WITH {CLUSTER_SQL}
SELECT tid, cluster_idx, CASE WHEN count(*) = 1 THEN 1 WHEN count(*) = 2 AND count(DISTINCT qname) = 1 THEN 2 ELSE 0 END AS clt_type
FROM clu GROUP BY tid, cluster_idx""")
def cluster_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, reads = F.count(F.lit(1)), F.countDistinct("qname")
    return _clustered(spark, sf_dir).groupBy("tid", "cluster_idx").agg(clusters.cluster_type(n, reads).alias("clt_type"))


BACKGROUND_SQL = """
chrom AS (SELECT tid, max(pos) AS length FROM {aln} GROUP BY tid),
longest AS (SELECT tid, length FROM chrom ORDER BY length DESC, tid LIMIT 1),
bg AS (
  SELECT avg(CAST(nm - 1 AS DOUBLE) / (m1 + ins + m2)) AS bg_div, CAST(sum(m1 + ins + m2) AS DOUBLE) / any_value(length) AS bg_depth,
         median(lc + m1 + ins + m2 + rc) AS bg_read_len
  FROM {aln} JOIN longest USING (tid) WHERE flag & 260 = 0)"""


def _background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").withColumn("ops", C.parse(F.col("cigar")))
    lengths = rows.groupBy("tid").agg(F.max("pos").alias("length"))
    valid = rows.filter(segments.valid(F.col("flag"))).select(
        "tid", C.divergence(F.col("nm"), F.lit(1), F.col("ops")).alias("divergence"), C.map_length(F.col("ops")).alias("map_len"), C.total(F.col("ops"), "MIS=X").alias("read_len")
    )
    return clusters.background_stats(valid, lengths)


@query(f"""
WITH {BACKGROUND_SQL}
SELECT round(bg_div, 6) AS bg_div, round(bg_depth, 6) AS bg_depth, round(bg_read_len, 6) AS bg_read_len, (SELECT count(*) FROM chrom) AS num_chrom FROM bg""")
def background_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _background(spark, sf_dir).select(six(F.col("bg_div"), "bg_div"), six(F.col("bg_depth"), "bg_depth"), six(F.col("bg_read_len"), "bg_read_len"), "num_chrom")


FEATURES = ("aligned_frac", "low_mapq_frac", "dual_clip_frac", "mean_mapq", "mean_score", "mean_query_frac", "mean_divergence", "entropy", "balance_ratio", "num_seg_norm", *(f"aln_frac_{k}" for k in clusters.LOCATIONS))


@query(f"""
WITH {CLUSTER_SQL}, {BACKGROUND_SQL},
fresh AS (
  SELECT *, greatest(0, query_end - greatest(query_start, coalesce(max(query_end) OVER (PARTITION BY seg_id ORDER BY query_start, query_end, hit_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), query_start))) AS new_len FROM {{hit}}),
merged AS (
  SELECT seg_id, count(*) FILTER (new_len > 0) AS n_hits, sum(new_len) AS sum_map, sum(CASE WHEN new_len > 0 THEN divergence ELSE 0 END) AS sum_div,
         sum(CASE WHEN new_len > 0 THEN CAST(score AS DOUBLE) / map_len ELSE 0 END) AS sum_score
  FROM fresh GROUP BY seg_id),
j AS (
  SELECT c.*, coalesce(n_hits, 0) AS n_hits, coalesce(sum_map, 0) AS sum_map, coalesce(sum_div, 0) AS sum_div, coalesce(sum_score, 0) AS sum_score, bg.*
  FROM clu c LEFT JOIN merged m ON c.aln_id % 20000 = m.seg_id CROSS JOIN bg),
f AS (
  SELECT tid, cluster_idx, bg_div, bg_depth, count(*) AS n, avg(CASE WHEN n_hits > 0 THEN 1.0 ELSE 0.0 END) AS aligned_frac,
    count(*) FILTER (seg_type = 1) AS l, count(*) FILTER (seg_type = 2) AS m, count(*) FILTER (seg_type = 4) AS r, bit_or(seg_type) AS types,
    avg(CASE WHEN mapq < 5 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN aln_type = 5 THEN 1.0 ELSE 0.0 END) AS dual, avg(mapq) AS mq,
    {", ".join(f"avg(CASE WHEN aln_id % 6 = {k} THEN 1.0 ELSE 0.0 END) AS at{1 << k}" for k in range(5))},
    avg(CASE WHEN n_hits > 0 THEN sum_score / n_hits ELSE 0 END) AS sc,
    avg(CASE WHEN n_hits > 0 THEN CAST(sum_map AS DOUBLE) / (query_end - query_start) ELSE 0 END) AS qf,
    avg(CASE WHEN n_hits > 0 THEN sum_div / n_hits ELSE bg_div END) AS dv
  FROM j GROUP BY tid, cluster_idx, bg_div, bg_depth),
e AS (
  SELECT *, -(CASE WHEN l > 0 THEN l::DOUBLE / n * log2(l::DOUBLE / n) ELSE 0 END + CASE WHEN m > 0 THEN m::DOUBLE / n * log2(m::DOUBLE / n) ELSE 0 END
    + CASE WHEN r > 0 THEN r::DOUBLE / n * log2(r::DOUBLE / n) ELSE 0 END) AS ent, aligned_frac >= 0.8 AS ok FROM f)
SELECT tid, cluster_idx, n AS num_seg_raw, CAST(bit_count(types) AS INT) AS num_seg_type, round(CAST(aligned_frac AS DOUBLE), 6) AS aligned_frac,
  round(CASE WHEN ok THEN low ELSE 0 END::DOUBLE, 6) AS low_mapq_frac, round(CASE WHEN ok THEN dual ELSE 0 END::DOUBLE, 6) AS dual_clip_frac,
  round(CASE WHEN ok THEN mq ELSE 0 END, 6) AS mean_mapq, round(CASE WHEN ok THEN sc ELSE 0 END, 6) AS mean_score,
  round(CASE WHEN ok THEN qf ELSE 0 END, 6) AS mean_query_frac, round(CASE WHEN ok THEN dv / bg_div ELSE 0 END, 6) AS mean_divergence,
  round(CASE WHEN ok THEN abs(ent) ELSE 0 END, 6) AS entropy, round(CASE WHEN ok THEN (least(l, r) + 0.01)::DOUBLE / (greatest(l, r) + 0.01)::DOUBLE ELSE 0 END, 6) AS balance_ratio,
  {", ".join(f"round(CASE WHEN ok THEN at{1 << k} ELSE 0 END::DOUBLE, 6) AS aln_frac_{1 << k}" for k in range(5))},
  round(CASE WHEN ok THEN n / bg_depth ELSE 0 END, 6) AS num_seg_norm
FROM e""")
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = te_hits.merge_hits(view(spark, sf_dir, "hit"), ties=("hit_id",))
    rows = _clustered(spark, sf_dir).withColumns(
        {"seg_id": F.col("aln_id") % 20000, "query_len": F.col("query_end") - F.col("query_start"), "aln_location": F.pow(F.lit(2), F.col("aln_id") % 6).cast("int")}
    )
    rows = te_hits.attach_hits(rows, merged)
    made = clusters.cluster_features(rows, _background(spark, sf_dir))
    # |x| turns a negative zero into zero
    rounded = [F.round(F.abs(F.col(c)) if c == "entropy" else F.col(c), 6).alias(c) for c in FEATURES]
    return made.select("tid", "cluster_idx", "num_seg_raw", F.col("num_seg_type").cast("int").alias("num_seg_type"), *rounded)


@query(f"""
WITH {CLUSTER_SQL},
c AS (SELECT tid, cluster_idx, count(*) AS n, min(ref_pos) % 10 AS x, max(ref_pos) % 7 AS y FROM clu GROUP BY tid, cluster_idx)
SELECT tid, cluster_idx, n = 1 AND x >= 8 AND y > 0 AS low_model, n > 1 AND x >= 8 AND y > 0 AS high_model, y = 0 OR CAST(x AS DOUBLE) / 10 <= 0.5 AS low_quality
FROM c""")
def model_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clustered(spark, sf_dir).groupBy("tid", "cluster_idx").agg(
        F.when(F.count(F.lit(1)) == 1, 1).otherwise(0).alias("t"), (F.min("ref_pos") % 10).cast("double").alias("x"), (F.max("ref_pos") % 7 == 0).alias("black")
    )
    t, x, black = F.col("t"), F.col("x") / 10, F.col("black")
    return rows.select(
        "tid",
        "cluster_idx",
        clusters.model_gate(t, x, black, high=False).alias("low_model"),
        clusters.model_gate(t, x, black, high=True).alias("high_model"),
        clusters.low_quality(black, x).alias("low_quality"),
    )


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
f AS (SELECT *, CASE WHEN sec > lag(sec) OVER w + 3600 OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS BIGINT) AS session FROM f)
SELECT user_id, session, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS n FROM s GROUP BY user_id, session""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = F.expr("unix_seconds(cast(ts as timestamp))")
    rows = events.select("user_id", "event_id", second.alias("sec"))
    made = clusters.cluster_by_gap(rows, group="user_id", pos="sec", gap=3600, ties=("event_id",), tile=1 << 40, index="session")
    return made.groupBy("user_id", "session").agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), F.count(F.lit(1)).alias("n"))


# --- intervals ------------------------------------------------------------------------


@query("""
SELECT aln_id, any_value(aln.tid) AS tid, count(ivl.tid) AS n_overlap, min(least(abs(pos - i_start), abs(pos - i_end))) AS min_distance
FROM {aln} LEFT JOIN {ivl} ON aln.tid = ivl.tid AND i_start < pos + 50 AND i_end > greatest(0, pos - 50)
GROUP BY aln_id""")
def interval_point_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "aln").select("aln_id", "tid", "pos")
    found = intervals.point_flank_join(points, view(spark, sf_dir, "ivl"), key=["aln_id"], chrom="tid", start="i_start", end="i_end")
    return found.select("aln_id", "tid", "n_overlap", "min_distance")


@query(f"""
WITH {CLUSTER_SQL},
c AS (SELECT tid, cluster_idx, min(ref_pos) - 1 AS s, max(ref_pos) AS e FROM clu GROUP BY tid, cluster_idx)
SELECT c.tid, cluster_idx, count(ivl.tid) AS n_overlap,
  min(least(abs(s - i_start), abs(s - i_end), abs(e - i_start), abs(e - i_end))) AS min_distance,
  arg_min(ivl_id, struct_pack(a := i_start, b := i_end, c := ivl_id)) AS rep_id
FROM c LEFT JOIN {{ivl}} ON c.tid = ivl.tid AND i_start < e + 50 AND i_end > greatest(0, s - 50) GROUP BY c.tid, cluster_idx""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = clusters.cluster_bounds(_clustered(spark, sf_dir))
    found = intervals.interval_flank_join(
        bounds, view(spark, sf_dir, "ivl"), key=["tid", "cluster_idx"], chrom="tid", q_start="ref_start", q_end="ref_end", start="i_start", end="i_end", ident="ivl_id"
    )
    return found.select("tid", "cluster_idx", "n_overlap", "min_distance", "rep_id")


BLACK_SQL = """SELECT aln_id, tid, pos FROM {{aln}} WHERE {} EXISTS (
  SELECT 1 FROM {{ivl}} WHERE aln.tid = ivl.tid AND i_start < pos + 1 + 2 AND i_end > greatest(0, pos - 2))"""


def _black(spark: SparkSession, sf_dir: str, anti: bool) -> DataFrame:
    rows = view(spark, sf_dir, "aln").select("aln_id", "tid", "pos", (F.col("pos") + 1).alias("stop"))
    black = view(spark, sf_dir, "ivl")
    found = intervals.overlapping(rows, black, chrom="tid", q_start="pos", q_end="stop", start="i_start", end="i_end", anti=anti, key=["aln_id"])
    return found.select("aln_id", "tid", "pos")


@query(BLACK_SQL.format(""))
def blacklist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _black(spark, sf_dir, False)


@query(BLACK_SQL.format("NOT"))
def blacklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _black(spark, sf_dir, True)


@query("""
WITH p AS (
  SELECT aln_id, side, count(ivl.tid) AS n, min(least(abs(spot - i_start), abs(spot - i_end))) AS d
  FROM (SELECT aln_id, tid, 0 AS side, pos AS spot FROM {aln} UNION ALL SELECT aln_id, tid, 1, pos + m1 + m2 FROM {aln}) e
  LEFT JOIN {ivl} ON e.tid = ivl.tid AND i_start < spot + 50 AND i_end > greatest(0, spot - 50) GROUP BY aln_id, side),
t AS (SELECT aln_id, side, CASE WHEN n = 0 THEN 1 WHEN d < 50 THEN 2 ELSE 4 END AS k FROM p)
SELECT aln_id, CASE WHEN bit_or(k) IN (1, 5) THEN 1 WHEN bit_or(k) = 4 THEN 2 WHEN bit_or(k) = 2 THEN 4 WHEN bit_or(k) = 3 THEN 8
  WHEN bit_or(k) = 6 THEN 16 ELSE 0 END AS aln_location FROM t GROUP BY aln_id""")
def location_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "ivl")
    return locate(view(spark, sf_dir, "aln"), known.filter("ivl_id % 2 = 0"), known.filter("ivl_id % 2 <> 0"))


# --- hits -----------------------------------------------------------------------------


@query("""
WITH f AS (
  SELECT *, greatest(0, query_end - greatest(query_start, coalesce(max(query_end) OVER (PARTITION BY seg_id ORDER BY query_start, query_end, hit_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), query_start))) AS new_len FROM {hit})
SELECT seg_id, count(*) FILTER (new_len > 0) AS n_hits, CAST(sum(new_len) AS BIGINT) AS sum_map,
  round(sum(CASE WHEN new_len > 0 THEN divergence ELSE 0 END), 6) AS sum_divergence,
  round(sum(CASE WHEN new_len > 0 THEN CAST(score AS DOUBLE) / map_len ELSE 0 END), 6) AS sum_score
FROM f GROUP BY seg_id""")
def te_hit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = te_hits.merge_hits(view(spark, sf_dir, "hit"), ties=("hit_id",))
    return rows.select("seg_id", "n_hits", "sum_map", six(F.col("sum_divergence"), "sum_divergence"), six(F.col("sum_score"), "sum_score"))


@query("""
SELECT seg_id, count(*) FILTER (reverse = seg_reverse) AS n_same, count(*) FILTER (reverse <> seg_reverse) AS n_opposite,
  CASE WHEN count(*) FILTER (reverse = seg_reverse) > count(*) FILTER (reverse <> seg_reverse) THEN 1
       WHEN count(*) FILTER (reverse = seg_reverse) < count(*) FILTER (reverse <> seg_reverse) THEN 2 END AS vote
FROM {hit} GROUP BY seg_id""")
def strand_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = te_hits.strand_votes(view(spark, sf_dir, "hit"), key=["seg_id"], segment_reverse="seg_reverse", hit_reverse="reverse")
    return votes.withColumn("vote", clusters.vote(F.col("n_same"), F.col("n_opposite")))


@query("""
WITH n AS (SELECT seg_id, te_tid, count(*) AS n FROM {hit} GROUP BY seg_id, te_tid)
SELECT seg_id, te_tid, n FROM n QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY n DESC, te_tid) = 1""")
def majority_te(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.majority(view(spark, sf_dir, "hit"), key=["seg_id"], value="te_tid")


@query("""
SELECT te_tid, arg_max(query_end, hit_id) AS ltr_len FROM {hit} WHERE NOT reverse AND query_start <= 10 AND map_len % 20 <= 10 GROUP BY te_tid""")
def ltr_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "hit").select(
        "te_tid", "reverse", F.col("query_start").alias("ref_start"), F.col("query_end").alias("ref_end"), (F.col("map_len") % 20).alias("right_clip"), F.col("hit_id").alias("ordinal")
    )
    return te_hits.ltr_length(rows)


# --- rules ----------------------------------------------------------------------------


@query("""
WITH b AS (
  SELECT cluster_id, clt_type, flag, flag & 229376 <> 0 AS retro, flag & 262144 <> 0 AS ltr, flag & 6291456 = 6291456 AS near, flag & 1536 = 1536 AS full_,
    flag & 16384 <> 0 AS self, flag & 8192 <> 0 AS single, flag & 256 <> 0 AS tsd, flag & 8388608 <> 0 AS solo, flag & 128 <> 0 AS polya,
    flag & 1048576 <> 0 AS rich, (flag & 2097152 <> 0) <> (flag & 4194304 <> 0) AS one FROM {clt}),
r AS (
  SELECT *, CASE WHEN retro THEN near AND (polya OR rich OR (NOT self AND full_ AND single))
      WHEN ltr THEN (full_ OR solo) AND near AND (tsd OR NOT self) ELSE full_ AND near AND (tsd OR NOT self) END AS ok,
    retro AND polya AND one AS tail,
    clt_type <> 0 AND single AND near AND ((flag & 512 <> 0 AND flag & 4096 <> 0) OR (NOT retro AND flag & 2048 <> 0 AND flag & 1024 <> 0)) AS second FROM b)
SELECT cluster_id, flag | CASE WHEN ok THEN 1 ELSE 0 END | CASE WHEN tail THEN 33554432 ELSE 0 END | CASE WHEN second THEN 16777216 ELSE 0 END AS flag FROM r""")
def post_filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "clt")
    return rows.select("cluster_id", filters.post_filter(F.col("flag"), F.col("clt_type")).alias("flag"))


@query("""
WITH c AS (SELECT cluster_id, CAST(flag % 7 - 1 AS INT) AS t1, CAST(flag % 900 AS INT) AS l, CAST(flag % 800 AS INT) AS o1, CAST(flag % 5 - 1 AS INT) AS t2,
  CAST(flag % 1300 AS INT) AS r, CAST(flag % 700 AS INT) AS o2 FROM {clt})
SELECT cluster_id, CASE WHEN t1 < 0 AND t2 < 0 THEN 0 WHEN o1 > 400 AND o2 > 400 THEN 0 WHEN t2 < 0 THEN 4 WHEN t1 < 0 THEN 8 WHEN o2 > 400 THEN 4
  WHEN o1 > 400 THEN 8 WHEN t1 = t2 AND l <= r - 100 THEN 32 WHEN t1 <> t2 THEN 16 ELSE 0 END AS flank_flag FROM c""")
def flank_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda m, shift=0: (F.col("flag") % m - shift).cast("int")
    flag = annotate.flank_flag(x(7, 1), x(900), x(800), x(5, 1), x(1300), x(700))
    return view(spark, sf_dir, "clt").select("cluster_id", flag.alias("flank_flag"))


@query("""
WITH c AS (SELECT cluster_id, CASE WHEN flag % 4 > 0 THEN CAST(flag % 130 AS INT) END AS l, CASE WHEN flag % 3 > 0 THEN CAST(flag % 110 AS INT) END AS r,
  CAST(flag % 100000 AS INT) AS s FROM {clt})
SELECT cluster_id, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN s + least(l, r) ELSE s + coalesce(l, r) - 1 END AS new_start,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN s + greatest(l, r) ELSE s + coalesce(l, r) END AS new_end,
  coalesce(r < l AND l - r < 50, false) AS tsd FROM c""")
def tsd_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flag")
    left, right = F.when(f % 4 > 0, (f % 130).cast("int")), F.when(f % 3 > 0, (f % 110).cast("int"))
    made = annotate.refine_breakpoint(left, right, (f % 100000).cast("int"))
    return view(spark, sf_dir, "clt").select("cluster_id", made["start"].alias("new_start"), made["end"].alias("new_end"), made["tsd"].alias("tsd"))


@query("""
SELECT cluster_id, CASE WHEN sum(s) > 0 THEN '+' WHEN sum(s) < 0 THEN '-' ELSE '.' END AS strand, coalesce(max(c), '') AS class,
  string_agg(concat(CASE WHEN reverse THEN '-' ELSE '+' END, ':', query_start, '-', query_end), ',' ORDER BY query_start, query_end, tid, reverse, ref_start) AS regions,
  string_agg(concat(CASE WHEN tid = -1 THEN 'PolyA' WHEN tid = -2 THEN 'PolyT' ELSE te_name END, ':', ref_start, '-', ref_end), ','
    ORDER BY query_start, query_end, tid, reverse, ref_start) AS sources
FROM (SELECT *, CASE WHEN tid < 0 THEN 0 WHEN reverse THEN -1 ELSE 1 END AS s FROM {ann}) a
LEFT JOIN (SELECT cluster_id, string_agg(te_name, ',' ORDER BY tid) AS c FROM (SELECT DISTINCT cluster_id, tid, te_name FROM {ann} WHERE tid >= 0) GROUP BY cluster_id) n USING (cluster_id)
GROUP BY cluster_id""")
def annotation_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotation_strings(view(spark, sf_dir, "ann"))


@query("""
SELECT cluster_id, ann_id, query_start - lag(query_end) OVER w AS gap_before, lead(query_start) OVER w - query_end AS gap_behind
FROM {ann} WINDOW w AS (PARTITION BY cluster_id ORDER BY query_start, query_end, tid, ann_id)""")
def neighbour_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ann").withColumn("tid", F.struct("tid", "ann_id"))
    return annotate.neighbour_gaps(rows).select("cluster_id", "ann_id", "gap_before", "gap_behind")


@query("""
WITH a AS (SELECT cluster_id, count(*) AS n, min(query_start) AS s, max(query_end) AS e FROM {ann} GROUP BY cluster_id),
f AS (SELECT cluster_id, flag | 1 AS flag, clt_type FROM {clt})
SELECT concat_ws('-', clt_type, cluster_id) AS id, s AS start, e AS "end", n AS n_support, flag FROM f JOIN a USING (cluster_id)""")
def final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "ann").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_support"), F.min("query_start").alias("start"), F.max("query_end").alias("end"))
    rows = view(spark, sf_dir, "clt").join(found, "cluster_id").withColumn("id", names.cluster_key(F.col("clt_type"), F.col("cluster_id")))
    made = rows.withColumn("flag", B.set_if(F.col("flag"), F.lit(True), B.PASS))
    blank = [c for c in annotate.RESULT if c not in made.columns]
    strings = made.select("id", *[F.lit(".").alias(c) for c in ("strand", "class", "regions", "sources")])
    rest = made.withColumns({c: F.lit(".") for c in blank if c not in strings.columns})
    return annotate.final_table(rest, strings).select("id", "start", "end", "n_support", "flag")


from gapline.plans import formats, population, stages  # noqa: E402, F401  register their queries
