"""Queries on allele statistics, labelling, sequences and the legacy operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions import sequences
from gapline.operators import consensus, label, legacy, popgen, simulate, te_hits
from gapline.operators.dsl import resolve_table, splice_column
from gapline.plans.registry import query, six
from gapline.plans.views import view
from gapline.sources.sinks import sync_line
from gapline.sources.text import base_counts, pileup_bases

# --- allele statistics ----------------------------------------------------------------


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of two samples; the second has the first one's counts in another order."""
    sample = lambda *names: F.struct(*[F.col(c).alias(f) for c, f in zip(names, popgen.FIELDS, strict=True)])
    both = F.array(sample("a1", "a2", "t1", "t2", "c1", "c2", "g1", "g2"), sample("c2", "a2", "t2", "g1", "a1", "c1", "g2", "t1"))
    rows = view(spark, sf_dir, "site")
    ref = F.element_at(F.array(*[F.lit(b) for b in popgen.BASES]), (F.col("pos") % 4 + 1).cast("int"))
    return rows.select("site_id", "chrom", "pos", ref.alias("ref"), both.alias("samples"))


SITE_SQL = """
s AS (
  SELECT site_id, chrom, pos, substr('ATCG', pos % 4 + 1, 1) AS ref,
    a1 + a2 AS xa, t1 + t2 AS xt, c1 + c2 AS xc, g1 + g2 AS xg, c2 + a2 AS ya, t2 + g1 AS yt, a1 + c1 AS yc, g2 + t1 AS yg,
    a1 + t1 + c1 + g1 AS xf, c2 + t2 + a1 + g2 AS yf, c2 + a1 AS paf, t1 + t2 AS ptf, c1 + a1 AS pcf, g1 + g2 AS pgf FROM {site}),
p AS (
  SELECT *, xa + xt + xc + xg AS xcov, ya + yt + yc + yg AS ycov, xa + ya AS pa, xt + yt AS pt, xc + yc AS pc, xg + yg AS pg FROM s),
r AS (
  SELECT *, list_sort([{{'k': -pa, 'b': 'A', 'x': xa, 'y': ya}}, {{'k': -pt, 'b': 'T', 'x': xt, 'y': yt}}, {{'k': -pc, 'b': 'C', 'x': xc, 'y': yc}}, {{'k': -pg, 'b': 'G', 'x': xg, 'y': yg}}]) AS al
  FROM p)""".replace("{{", "{").replace("}}", "}")


@query(f"""
WITH {SITE_SQL}
SELECT site_id, pa + pt + pc + pg AS cov, least(xcov, ycov) AS min_cov, greatest(xcov, ycov) AS max_cov, al[1].b AS major, -al[1].k AS n_major, al[2].b AS minor, -al[2].k AS n_minor,
  round(greatest(coalesce(abs(xf::DOUBLE / nullif(xcov, 0) - 0.5), 0), coalesce(abs(yf::DOUBLE / nullif(ycov, 0) - 0.5), 0)), 6) AS max_bias,
  (pa >= 5)::INT + (pt >= 5)::INT + (pc >= 5)::INT + (pg >= 5)::INT >= 2 AS polymorphic, pos % 100 = 1 AND pos > 1 AS simulated
FROM r""")
def snp_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, best = F.col("samples"), popgen.ranked_alleles(F.col("__pool"))
    rows = _sites(spark, sf_dir).withColumn("__pool", popgen.pooled(samples)).withColumn("__best", best)
    pick = lambda k, part: F.element_at("__best", k)[part]
    return rows.select(
        "site_id", popgen.coverage(F.col("__pool")).alias("cov"), popgen.min_coverage(samples).alias("min_cov"), popgen.max_coverage(samples).alias("max_cov"),
        pick(1, "base").alias("major"), pick(1, "n").alias("n_major"), pick(2, "base").alias("minor"), pick(2, "n").alias("n_minor"),
        six(popgen.max_bias(samples), "max_bias"), popgen.polymorphic(samples, 5).alias("polymorphic"), popgen.is_truth(F.col("pos")).alias("simulated"),
    )


@query(f"""
WITH {SITE_SQL},
f AS (SELECT site_id, al[1].x::DOUBLE / nullif(al[1].x + al[2].x, 0) AS a, al[1].y::DOUBLE / nullif(al[1].y + al[2].y, 0) AS b FROM r WHERE xcov >= 10 AND ycov >= 10),
h AS (SELECT site_id, 1 - a * a - (1 - a) * (1 - a) AS h1, 1 - b * b - (1 - b) * (1 - b) AS h2, 1 - ((a + b) / 2) * ((a + b) / 2) - (1 - (a + b) / 2) * (1 - (a + b) / 2) AS ht FROM f)
SELECT site_id, round(CASE WHEN ht IS NULL OR ht = 0 THEN 0 ELSE (ht - (h1 + h2) / 2) / ht END, 6) AS fst FROM h""")
def fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).filter(popgen.covered(F.col("samples"), 10))
    return rows.select("site_id", six(popgen.fst(F.col("samples")), "fst"))


@query(f"""
WITH {SITE_SQL},
b AS (SELECT CAST(floor(greatest(coalesce(abs(xf::DOUBLE / nullif(xcov, 0) - 0.5), 0), coalesce(abs(yf::DOUBLE / nullif(ycov, 0) - 0.5), 0)) / 0.05) AS BIGINT) AS bin FROM r),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT bin, n, round(sum(n) OVER (ORDER BY bin DESC)::DOUBLE / sum(n) OVER (), 6) AS share_above FROM n""")
def strand_bias_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).select(popgen.max_bias(F.col("samples")).alias("bias"))
    hist = popgen.reverse_cumulative(popgen.histogram(rows, value="bias", step=0.05))
    return hist.select("bin", "n", six(F.col("share_above"), "share_above"))


@query(f"""
WITH {SITE_SQL},
c AS (
  SELECT pos % 100 = 1 AND pos > 1 AS sim, xcov >= 20 AND ycov >= 20 AND (pa >= 3)::INT + (pt >= 3)::INT + (pc >= 3)::INT + (pg >= 3)::INT >= 2 AS pol,
    (pa + pt + pc + pg)::DOUBLE AS cov, (xf + yf)::DOUBLE / (pa + pt + pc + pg) AS fwd,
    CASE ref WHEN 'A' THEN pa WHEN 'T' THEN pt WHEN 'C' THEN pc ELSE pg END::DOUBLE / (pa + pt + pc + pg) AS rf FROM r)
SELECT count(*) FILTER (sim AND pol) AS tp, count(*) FILTER (NOT sim AND pol) AS fp, count(*) FILTER (sim AND NOT pol) AS fn_call, CAST(100000 - count(*) FILTER (sim) AS BIGINT) AS fn_pileup,
  round(avg(rf) FILTER (sim AND pol), 6) AS mean_ref_frac, round(stddev_pop(rf) FILTER (sim AND pol), 6) AS std_ref_frac,
  round(avg(fwd) FILTER (sim AND pol), 6) AS mean_fwd_frac, round(stddev_pop(fwd) FILTER (sim AND pol), 6) AS std_fwd_frac,
  round(avg(cov) FILTER (sim AND pol), 6) AS mean_cov, round(stddev_pop(cov) FILTER (sim AND pol), 6) AS std_cov,
  count(*) FILTER (sim AND pol AND abs(rf - 0.5) > 0.1) AS n_outlier FROM c""")
def snp_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popgen.confusion(popgen.call_snps(_sites(spark, sf_dir), least=20, min_count=3), total=100_000)
    return rows.select(*[six(F.col(c), c) if c.startswith(("mean", "std")) else c for c in rows.columns])


@query(f"""
WITH {SITE_SQL}
SELECT site_id, concat(xa, ':', xt, ':', xc, ':', xg, ':0:0', chr(9), ya, ':', yt, ':', yc, ':', yg, ':0:0') AS line FROM r WHERE xcov >= 15 AND ycov >= 15""")
def strand_sync_to_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).filter(popgen.covered(F.col("samples"), 15))
    return rows.select("site_id", sync_line(F.col("samples")).alias("line"))


def _fisher_sql(name: str, a: str, b: str, c: str, d: str) -> str:
    """-log10 of Fisher's two-sided probability: the tables with these margins that are at most as likely, summed."""
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    cells = lambda x: f"lgamma({x} + 1) + lgamma({row} - {x} + 1) + lgamma({col} - {x} + 1) + lgamma({n} - {row} - {col} + {x} + 1)"
    const = f"lgamma({row} + 1) + lgamma({n} - {row} + 1) + lgamma({col} + 1) + lgamma({n} - {col} + 1) - lgamma({n} + 1)"
    tables = f"list_transform(range(greatest(0, {row} + {col} - {n}), least({row}, {col}) + 1), lambda x: {const} - ({cells('x')}))"
    chance = f"list_sum(list_transform(list_filter({tables}, lambda p: p <= {const} - ({cells(a)}) + 1e-7), lambda p: exp(p)))"
    return f"round(CASE WHEN {chance} <= 0 THEN 100.0 ELSE greatest(0.0, -log10(least(1.0, {chance}))) END, 6) AS {name}"


_FORWARD = "(CASE al[{0}].b WHEN 'A' THEN paf WHEN 'T' THEN ptf WHEN 'C' THEN pcf ELSE pgf END)"


@query(f"""
WITH {SITE_SQL},
t AS (SELECT chrom, pos, al[1].x AS a, al[2].x AS b, al[1].y AS c, al[2].y AS d, {_FORWARD.format(1)} AS f1, {_FORWARD.format(2)} AS f2, -al[1].k AS n1, -al[2].k AS n2
  FROM r WHERE xcov >= 1 AND ycov >= 1),
u AS (SELECT *, n1 - f1 AS r1, n2 - f2 AS r2 FROM t)
SELECT chrom, pos, pos % 100 = 1 AND pos > 1 AS is_snp, false AS is_outlier, {_fisher_sql("strand_bias", "f1", "r1", "f2", "r2")}, {_fisher_sql("measure", "a", "b", "c", "d")} FROM u""")
def multimeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popgen.multimeasure(_sites(spark, sf_dir), bias="alleleimbalance", measure="fet", least=1)
    return rows.select("chrom", "pos", "is_snp", "is_outlier", six(F.col("strand_bias"), "strand_bias"), six(F.col("measure"), "measure"))


@query("""
SELECT CAST(floor(fl / 20) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (f & 4 = 0) AS n_mapped, count(*) FILTER (f & 4 <> 0) AS n_unmapped, count(*) FILTER (f & 2 <> 0) AS n_proper
FROM (SELECT mapq AS fl, CAST(aln_id % 8 AS INT) AS f FROM {aln}) GROUP BY bin""")
def mapq_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").select("mapq", (F.col("aln_id") % 8).cast("int").alias("flag"))
    return popgen.mapq_histogram(rows, width=20)


@query("""
WITH h AS (SELECT o_custkey AS pos, CAST(o_orderkey % 7 - 3 AS INT) AS id FROM orders), t AS (SELECT pos, count(*) AS total FROM h GROUP BY pos)
SELECT pos, id, count(*) AS n, round(count(*)::DOUBLE / any_value(total), 6) AS frequency FROM h JOIN t USING (pos) WHERE id <> 0 GROUP BY pos, id""")
def te_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sites = orders.groupBy(F.col("o_custkey").alias("pos")).agg(F.collect_list((F.col("o_orderkey") % 7 - 3).cast("int")).alias("ids"))
    return popgen.te_frequency(sites).withColumn("frequency", F.round("frequency", 6))


@query("""
SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS total, round(avg(length(seq)), 6) AS mean_length, round(100000 / avg(length(seq)), 6) AS coverage,
  CAST(ceil(avg(length(seq)) / 100) AS BIGINT) AS reads_for_one FROM {dna}""")
def genome_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popgen.genome_stats(view(spark, sf_dir, "dna"))
    return rows.select("n", "total", six(F.col("mean_length"), "mean_length"), six(F.col("coverage"), "coverage"), "reads_for_one")


# --- ranks ----------------------------------------------------------------------------


def _down(column: str) -> list[Column]:
    return [F.col(column).desc(), F.col("ord_id").asc()]


@query("""
SELECT ord_id, row_number() OVER (ORDER BY measure DESC, ord_id) <= 100 AS is_outlier FROM {ord}""")
def outlier_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ord")
    return popgen.top_outliers(rows, 100, order=_down("measure"), key=["ord_id"]).select("ord_id", "is_outlier")


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (is_outlier) AS p FROM {ord}),
r AS (SELECT row_number() OVER w AS rank, count(*) FILTER (is_outlier) OVER w AS hits FROM {ord} WINDOW w AS (ORDER BY strand_bias DESC, ord_id ROWS UNBOUNDED PRECEDING))
SELECT rank, round(hits::DOUBLE / p, 6) AS tpr, round((rank - hits)::DOUBLE / (n - p), 6) AS fpr FROM r, n WHERE rank % greatest(1, n // 50) = 0""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popgen.roc_points(view(spark, sf_dir, "ord"), 50, order=_down("strand_bias"))
    return rows.select(F.col("rank").cast("bigint").alias("rank"), six(F.col("tpr"), "tpr"), six(F.col("fpr"), "fpr"))


@query("""
WITH r AS (SELECT is_outlier AS truth, measure AS value, row_number() OVER (PARTITION BY is_outlier ORDER BY measure DESC, ord_id) AS rank, count(*) OVER (PARTITION BY is_outlier) AS n FROM {ord})
SELECT truth, rank, value FROM r WHERE rank IN (1, 10, 100) OR rank = CAST(floor(n * 0.05) AS BIGINT) OR rank = CAST(floor(n * 0.5) AS BIGINT)""")
def rank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popgen.pick_ranks(view(spark, sf_dir, "ord"), (1, 10, 100), (0.05, 0.5), value="measure", order=_down("measure"), truth="is_outlier")
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("""
SELECT CAST(floor(strand_bias / 0.03) AS BIGINT) AS bin, count(*) FILTER (is_outlier) AS n_true, count(*) FILTER (NOT is_outlier) AS n_false FROM {ord} GROUP BY bin""")
def measure_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.histogram(view(spark, sf_dir, "ord"), value="strand_bias", step=0.03, truth="is_outlier")


@query("""
WITH a AS (SELECT chrom, pos, measure FROM {ord} WHERE pos % 3 > 0), b AS (SELECT chrom, pos, 200000 - measure AS other FROM {ord} WHERE pos % 2 > 0)
SELECT chrom, pos, least(measure, other) AS low, greatest(measure, other) AS high, measure AS first, other AS second FROM a JOIN b USING (chrom, pos)""")
def merge_stats_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ord")
    a = rows.filter("pos % 3 > 0").select("chrom", "pos", F.col("measure").alias("value"))
    b = rows.filter("pos % 2 > 0").select("chrom", "pos", (200000 - F.col("measure")).alias("value"))
    merged = None
    for take, name in (("small", "low"), ("large", "high"), ("take1", "first"), ("take2", "second")):
        part = popgen.merge_statistics(a, b, take=take).withColumnRenamed("value", name)
        merged = part if merged is None else merged.join(part, ["chrom", "pos"])
    return merged


# --- labelling ------------------------------------------------------------------------


TRUTH_SQL = """
WITH j AS (
  SELECT aln_id, ivl_id, i_start, i_end FROM {aln} LEFT JOIN {ivl}
    ON aln.tid = ivl.tid AND i_start < pos + 20 + 50 AND i_end > greatest(0, pos - 50))
SELECT aln_id AS cand_id, count(i_start) AS n_truth, arg_max(ivl_id, {'a': i_start, 'b': i_end, 'c': ivl_id}) AS truth_id,
  CASE count(i_start) WHEN 0 THEN 'FP' WHEN 1 THEN 'TP' ELSE 'Special' END AS label FROM j GROUP BY aln_id"""


@query(TRUTH_SQL)
def truth_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").select(F.col("aln_id").alias("cand_id"), "tid", "pos", (F.col("pos") + 20).alias("stop"))
    made = label.classify(rows, view(spark, sf_dir, "ivl"), chrom="tid", start="pos", end="stop", t_start="i_start", t_end="i_end", t_id="ivl_id")
    return made.select("cand_id", "n_truth", "truth_id", "label")


MATRIX_SQL = """
cell AS (SELECT o_custkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS col,
  CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE concat('d', o_orderkey % 3) END AS def_name FROM orders)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.when(F.col("o_orderkey") % 3 == 0, "*").otherwise(F.concat(F.lit("d"), F.col("o_orderkey") % 3))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("pos"))
    cells = rows.agg(F.array_sort(F.collect_list(F.struct("o_orderkey", token.alias("t")))).alias("c"))
    return cells.select("pos", F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("cells"))


@query(f"""
WITH {MATRIX_SQL}
SELECT pos, def_name, array_to_string(list_sort(list(DISTINCT CAST(col + 100 * (pos % 4) AS INT))), ',') AS hgs FROM cell WHERE def_name <> '*' GROUP BY pos, def_name""")
def carrier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matrix(spark, sf_dir).withColumn("part", (F.col("pos") % 4).cast("int"))
    made = label.carriers(rows, order="part", sub=100)
    return made.select("pos", "def_name", F.array_join(F.transform("hgs", lambda h: h.cast("string")), ",").alias("hgs"))


SUPPORT_SQL = """
WITH r AS (SELECT aln_id, tid, pos, pos + m1 AS stop, CAST(aln_id % 7 AS INT) AS hg, CASE WHEN mapq > 6 THEN tid ELSE 9 END AS origin FROM {aln}),
i AS (SELECT ivl_id, tid, i_start, i_end FROM {ivl})
SELECT aln_id, ivl_id, CAST(ivl_id % 7 AS INT) IN (hg, (hg + 3) % 7) AND origin = r.tid AS supports
FROM r JOIN i ON r.tid = i.tid AND i_start < stop + 50 AND i_end > greatest(0, pos - 50)"""


@query(SUPPORT_SQL)
def support_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = view(spark, sf_dir, "aln")
    reads = aln.select(
        "aln_id", F.col("tid").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + F.col("m1")).alias("end"), (F.col("aln_id") % 7).cast("int").alias("hg"),
        F.when(F.col("mapq") > 6, F.col("tid")).otherwise(9).alias("origin_chrom"),
    )
    ins = view(spark, sf_dir, "ivl").select(F.col("ivl_id").alias("ins_id"), F.col("tid").alias("chrom"), "i_start", "i_end")
    own = (F.col("ins_id") % 7).cast("int")
    carried = ins.select("ins_id", F.explode(F.array(own, (own + 4) % 7)).alias("hg"))
    return label.support(reads, ins, carried).select("aln_id", F.col("ins_id").alias("ivl_id"), "supports")


@query("""
WITH s AS (SELECT aln_id % 5000 AS cand_id, qname, tid, CASE WHEN mapq > 30 THEN tid ELSE 9 END AS origin FROM {aln})
SELECT cand_id, count(DISTINCT qname) AS n_reads, count(*) FILTER (tid = origin) AS n_consistent FROM s GROUP BY cand_id""")
def consistent_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").select(
        (F.col("aln_id") % 5000).alias("cand_id"), "qname", F.col("tid").alias("chrom"), F.when(F.col("mapq") > 30, F.col("tid")).otherwise(9).alias("origin_chrom")
    )
    return label.consistent_reads(rows)


@query("""
SELECT ivl_id AS cand_id, CASE WHEN ivl_id IN (SELECT aln_id % 40000 FROM {aln}) THEN 'FP' ELSE 'TP' END AS label FROM {ivl}""")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ivl").select(F.col("ivl_id").alias("cand_id"), F.lit("TP").alias("label"))
    log = view(spark, sf_dir, "aln").select((F.col("aln_id") % 40000).alias("cand_id"))
    return label.relabel(rows, log)


# --- sequences ------------------------------------------------------------------------


@query("SELECT doc_id, translate(reverse(seq), 'ACGTN', 'TGCAN') AS rc, length(seq) AS n FROM {dna}")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "dna").select("doc_id", sequences.reverse_complement(F.col("seq")).alias("rc"), F.char_length("seq").cast("bigint").alias("n"))


@query("""
WITH r AS (SELECT doc_id, regexp_extract_all(seq, 'A+|C+|G+|T+|N+') AS runs FROM {dna}),
u AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS k FROM r),
p AS (SELECT doc_id, run, CAST(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS run_end FROM u)
SELECT doc_id, CAST(run_end - length(run) AS INT) AS run_start, run_end, left(run, 1) AS base FROM p WHERE length(run) >= 3""")
def homopolymer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "dna").select("doc_id", F.explode(sequences.homopolymer_runs(F.col("seq"), 3)).alias("r"))
    return rows.select("doc_id", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"), F.col("r.base").alias("base"))


@query("""
SELECT doc_id, CASE WHEN length(seq) <= 20 THEN repeat('N', length(seq)) ELSE concat('NNNNNNNNNN', substr(seq, 11, length(seq) - 20), 'NNNNNNNNNN') END AS masked,
  nullif(replace(seq, 'N', ''), '') AS stripped,
  CASE WHEN length(seq) < 5 THEN 1 WHEN length(seq) < 10 THEN 2 WHEN length(seq) < 40 THEN 3 WHEN length(seq) < 70 THEN 4 ELSE 5 END AS edge,
  CASE WHEN length(seq) > 7 AND substr(seq, 7, 1) = substr(seq, 8, 1) THEN 1 ELSE 0 END AS extra
FROM {dna}""")
def sequence_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    extra = F.when(F.char_length(seq) > 7, sequences.extra_length(seq, F.lit(7))).otherwise(0)
    return view(spark, sf_dir, "dna").select(
        "doc_id", sequences.mask_ends(seq, 10).alias("masked"), sequences.strip_n(seq).alias("stripped"), sequences.min_edge(F.char_length(seq)).alias("edge"), extra.alias("extra")
    )


def _tail_sql(text: str, keep: bool) -> str:
    """The fold of an A tail's scan over a text; with ``keep`` a reset leaves the best stretch and no stretches are listed."""
    total = "(a.total + CASE x.b WHEN 'A' THEN 1 WHEN 'T' THEN -1 ELSE -3 END)"
    misses = "(a.misses + CASE x.b WHEN 'A' THEN 0 ELSE 1 END)"
    up, stop = f"{total} > a.top", f"({total} < 0 OR {misses} > 10)"
    best, top, at = (f"CASE WHEN {up} THEN {new} ELSE a.{old} END" for new, old in (("a.size + 1", "best"), (total, "top"), ("a.i", "at")))
    fresh = lambda c: f"CASE WHEN {stop} THEN 0 ELSE {c} END"
    held = (lambda c: c) if keep else fresh
    good = f"({best}) >= 5 AND (n - ({best}) + 1) * pow(0.25, {best}) <= 0.01"
    found = "a.found" if keep else f"CASE WHEN {stop} AND {good} THEN list_append(a.found, {{'at': {at}, 'size': {best}}}) ELSE a.found END"
    none = "CAST([] AS STRUCT(\"at\" INT, size INT)[])"
    zero = lambda c: f"{{'b': {c}, 'i': 0, 'size': 0, 'total': 0, 'misses': 0, 'best': 0, 'top': 0, 'at': 0, 'found': {none}}}"
    step = f"""{{'b': x.b, 'i': a.i + 1, 'size': {fresh("a.size + 1")}, 'total': {fresh(total)}, 'misses': {fresh(misses)},
      'best': {held(best)}, 'top': {held(top)}, 'at': {at}, 'found': {found}}}"""
    letters = f"list_transform(string_split({text}, ''), lambda c: {zero('c')})"
    return f"list_reduce({letters}, lambda a, x: {step}, {zero(chr(39) * 2)})"


@query(f"""
WITH s AS (SELECT doc_id, concat(seq, repeat('A', CAST(doc_id % 25 AS INT)), 'CGT') AS s FROM {{dna}}),
l AS (SELECT doc_id, s, length(s) AS n FROM s),
w AS (SELECT doc_id, n, {_tail_sql("s", False)} AS t, {_tail_sql("right(s, 20)", True)} AS f FROM l),
c AS (SELECT doc_id, CASE WHEN t.best >= 5 AND (n - t.best + 1) * pow(0.25, t.best) <= 0.01 THEN list_append(t.found, {{'at': t.at, 'size': t.best}}) ELSE t.found END AS found,
  n >= 20 AND f.at <= 5 AND f.best >= 5 AND (20 - f.best + 1) * pow(0.25, f.best) <= 0.01 AS flank FROM w),
u AS (SELECT doc_id, flank, unnest(found) AS x FROM c)
SELECT doc_id, CAST(x.at + 1 - x.size AS INT) AS tail_start, CAST(x.at + 1 AS INT) AS tail_end, flank FROM u""")
def poly_tail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "dna").select("doc_id", F.concat("seq", F.repeat(F.lit("A"), (F.col("doc_id") % 25).cast("int")), F.lit("CGT")).alias("s"))
    tails = rows.select("doc_id", F.explode(sequences.poly_tails(F.col("s"), True)).alias("t"), sequences.flank_has_tail(F.right("s", F.lit(20)), True).alias("flank"))
    return tails.select("doc_id", F.col("t.start").alias("tail_start"), F.col("t.end").alias("tail_end"), "flank")


@query("""
WITH o AS (SELECT l_orderkey AS region, l_linenumber % 4 + 3 AS ref_length, CAST(l_partkey % 4 + 3 AS INT) AS length FROM lineitem),
f AS (SELECT region, min(ref_length) AS ref_length FROM o GROUP BY region),
n AS (SELECT region, f.ref_length, length, count(*) AS n FROM o JOIN f USING (region) GROUP BY ALL),
b AS (SELECT region, ref_length, coalesce(max(n) FILTER (length = ref_length), 0) AS same, max(n) FILTER (length <> ref_length) AS best,
  arg_max(length, n * 100 - length) FILTER (length <> ref_length) AS l FROM n GROUP BY region, ref_length)
SELECT region, ref_length, CASE WHEN coalesce(best, 0) > same THEN l ELSE ref_length END AS new_length, CASE WHEN coalesce(best, 0) > same THEN l ELSE ref_length END <> ref_length AS changed FROM b""")
def run_length_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("region"), (F.col("l_linenumber") % 4 + 3).alias("r"), (F.col("l_partkey") % 4 + 3).cast("int").alias("length")
    )
    ref = rows.groupBy("region").agg(F.min("r").alias("ref_length"))
    return consensus.run_length_vote(rows.join(ref, "region"), key=["region"])


@query("""
WITH o AS (SELECT l_orderkey AS col, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS base FROM lineitem),
f AS (SELECT col, substr('ACGT', CAST(col % 4 + 1 AS INT), 1) AS ref_base, base, count(*) AS n FROM o GROUP BY col, base)
SELECT col, ref_base, base AS consensus, n, CAST(sum(n) OVER (PARTITION BY col) AS BIGINT) AS depth FROM f
QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, base <> ref_base, base) = 1""")
def base_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda c: F.substr(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("col"), letter("l_orderkey").alias("ref_base"), letter("l_partkey").alias("base"))
    return consensus.base_vote(rows, key=["col"])


@query("""
WITH o AS (SELECT l_orderkey AS col, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'CC' END AS ins FROM lineitem),
n AS (SELECT col, ins, count(*) AS n FROM o GROUP BY col, ins),
t AS (SELECT col, coalesce(sum(n) FILTER (ins <> ''), 0) AS w, sum(n) AS depth FROM n GROUP BY col),
b AS (SELECT col, ins FROM n WHERE ins <> '' QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, ins) = 1)
SELECT col, CASE WHEN w >= 0.5 * depth THEN coalesce(ins, '') ELSE '' END AS insertion, CAST(depth AS BIGINT) AS depth FROM t LEFT JOIN b USING (col)""")
def insertion_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("col"), F.when(k == 0, "").when(k == 1, "A").otherwise("CC").alias("inserted"))
    return consensus.insertion_consensus(rows, key=["col"])


@query("""
WITH p AS (SELECT p_partkey AS id, upper(replace(p_name, ' ', '')) AS s, CAST(p_size % 3 AS INT) AS tsd FROM part)
SELECT id, concat(left(s, 4), 'GATTACA', substr(s, 5 - tsd, tsd), substr(s, 5)) AS spliced FROM p WHERE length(s) >= 4""")
def dsl_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("s"), (F.col("p_size") % 3).cast("int").alias("tsd"))
    inserts = F.array(F.struct(F.lit(4).alias("pos"), F.lit("GATTACA").alias("seq"), F.col("tsd").alias("tsd")))
    return rows.filter(F.char_length("s") >= 4).select("id", splice_column(F.col("s"), inserts).alias("spliced"))


@query("""
WITH p AS (SELECT p_partkey AS id, CAST(p_size AS INT) AS n, CAST(p_partkey % (p_size + 1) AS INT) AS k FROM part)
SELECT id, CASE WHEN k >= 3 THEN concat(repeat('A', k), 'GT', 'TT', 'ACGTAC', repeat('A', 3), repeat('A', n - k)) END AS seq, CASE WHEN k >= 3 THEN 0 END AS tsd,
  CASE WHEN k < 3 THEN concat('position ', k, ' does not fit a duplication of 3 in ', n, ' bases') END AS error FROM p""")
def dsl_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested definitions, resolved by recursion; the twin spells out what they come to."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.array(F.repeat(F.lit("A"), F.col("p_size")), F.lit("ACGTACGTAC")).alias("base_seqs"),
        F.array(F.lit("x=$2[1..2]-3bp")).alias("definitions"),
        F.concat(F.lit("$1+{"), (F.col("p_partkey") % (F.col("p_size") + 1)).cast("string"), F.lit(":x+{2:\"TT\"+}}")).alias("query"),
    )
    return resolve_table(rows).select("id", "seq", "tsd", "error")


@query("""
SELECT doc_id, replace(replace(seq, 'A', '.'), 'C', ',') AS text, length(replace(seq, 'G', '')) AS n FROM {dna}""")
def pileup_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pileup strings built from sequences and read back: an indel of each is skipped."""
    rows, seq = view(spark, sf_dir, "dna"), F.col("seq")
    text = F.replace(F.replace(seq, F.lit("A"), F.lit(".")), F.lit("C"), F.lit(","))
    noisy = F.concat(F.lit("^~"), text, F.lit("+2GG$"))
    counts = base_counts(pileup_bases(F.lit("T"), noisy), F.repeat(F.lit("I"), F.char_length(seq)))
    n = sum((counts[k] for k in popgen.FIELDS), F.lit(0)) - counts["Gf"]
    back = F.replace(F.replace(noisy, F.lit("^~"), F.lit("")), F.lit("+2GG$"), F.lit(""))
    missing = F.char_length(F.regexp_replace(text, "[^N]", ""))
    return rows.select("doc_id", back.alias("text"), (n + missing).cast("bigint").alias("n"))


# --- legacy and simulators ------------------------------------------------------------


@query("""
WITH s AS (SELECT DISTINCT aln_id % 3000 AS cluster_id, qname, mapq > 40 AS spans, lc > 0 AS l, rc > 0 AS r FROM {aln} WHERE aln_id % 2 = 0),
p AS (SELECT cluster_id, qname, bool_or(spans) AS spans, bool_or(l) AS l, bool_or(r) AS r FROM s GROUP BY ALL),
w AS (SELECT cluster_id, CAST(sum(CASE WHEN spans OR (l AND r) THEN 2 ELSE 1 END) AS BIGINT) AS weight, count(*) AS n_reads FROM p GROUP BY cluster_id),
u AS (SELECT aln_id % 3000 AS cluster_id, count(DISTINCT qname) AS n FROM {aln} WHERE aln_id % 2 = 1 GROUP BY ALL)
SELECT cluster_id, weight, n_reads, coalesce(n, 0) AS n_unsupp, round(weight::DOUBLE / (weight + 2 * coalesce(n, 0)), 6) AS frequency FROM w LEFT JOIN u USING (cluster_id)""")
def insertion_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").withColumn("cluster_id", F.col("aln_id") % 3000)
    support = rows.filter("aln_id % 2 = 0").select("cluster_id", "qname", (F.col("mapq") > 40).alias("spans"), (F.col("lc") > 0).alias("left"), (F.col("rc") > 0).alias("right"))
    made = legacy.insertion_frequency(support, rows.filter("aln_id % 2 = 1").select("cluster_id", "qname"))
    return made.withColumn("frequency", F.round("frequency", 6))


@query("""
WITH b AS (SELECT aln_id % 3000 AS cluster_id, tid, min(pos) AS s, max(pos) AS e FROM {aln} WHERE mapq > 50 GROUP BY ALL)
SELECT cluster_id, b.tid, s AS bp_start, e AS bp_end FROM b WHERE NOT EXISTS (
  SELECT 1 FROM {ivl} WHERE ivl.tid = b.tid AND i_start < e + 5 AND i_end > greatest(0, s - 5))""")
def not_in_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").filter("mapq > 50").withColumn("cluster_id", F.col("aln_id") % 3000)
    found = rows.groupBy("cluster_id", "tid").agg(F.min("pos").alias("bp_start"), F.max("pos").alias("bp_end"))
    tagged = found.select(F.concat_ws(":", "cluster_id", "tid").alias("id"), "cluster_id", "tid", "bp_start", "bp_end", F.col("tid").alias("chrom"), F.lit("x").alias("te"), F.lit("+").alias("strand"))
    repeats = view(spark, sf_dir, "ivl").select(F.col("tid").alias("chrom"), F.col("i_start").alias("start"), F.col("i_end").alias("end"), F.lit("x").alias("te"), F.lit("+").alias("strand"))
    return legacy.not_in_repeats(tagged, repeats, key="id").select("cluster_id", "tid", "bp_start", "bp_end")


def _seed_sql() -> str:
    """Seeds are found by doubled steps, 2^14 of which pass every chromosome."""
    parts = ["a AS (SELECT aln_id, tid, pos FROM {aln} WHERE mapq > 0)"]
    parts.append(
        "j0 AS (SELECT tid, pos, min(pos) OVER (PARTITION BY tid ORDER BY pos RANGE BETWEEN 202 FOLLOWING AND UNBOUNDED FOLLOWING) AS follow FROM (SELECT DISTINCT tid, pos FROM a))"
    )
    parts.append("r0 AS (SELECT tid, min(pos) AS pos FROM a GROUP BY tid)")
    for k in range(14):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} UNION SELECT tid, follow FROM r{k} JOIN j{k} USING (tid, pos) WHERE follow IS NOT NULL)")
        parts.append(f"j{k + 1} AS MATERIALIZED (SELECT x.tid, x.pos, y.follow FROM j{k} x JOIN j{k} y ON y.tid = x.tid AND y.pos = x.follow)")
    return f"WITH {', '.join(parts)} SELECT aln_id, 1 AS n_windows, CAST(r14.pos AS BIGINT) AS first_window FROM a ASOF JOIN r14 ON a.tid = r14.tid AND a.pos >= r14.pos"


@query(_seed_sql())
def seed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows seeded in the order of rows."""
    made = legacy.seed_windows(view(spark, sf_dir, "aln").filter("mapq > 0").select("aln_id", "tid", "pos"), tile=1 << 17)
    return made.select("aln_id", F.size("windows").alias("n_windows"), F.array_min("windows").alias("first_window"))


@query("""
WITH c AS (SELECT tid, max(pos) AS length FROM {aln} GROUP BY tid), n AS (SELECT *, CAST(floor(1000 * length / (SELECT sum(length) FROM c)) AS BIGINT) AS k FROM c)
SELECT tid, length, CAST(CASE WHEN tid = (SELECT max(tid) FROM c) THEN 1000 - (SELECT sum(k) FROM n) + k ELSE k END AS BIGINT) AS n FROM n""")
def allocate_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = view(spark, sf_dir, "aln").groupBy("tid").agg(F.max("pos").alias("length"))
    return simulate.allocate(contigs, 1000)


@query()
def simulated_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random insertions; tested for determinism and bounds."""
    contigs = view(spark, sf_dir, "aln").groupBy("tid").agg(F.max("pos").alias("length")).withColumn("chrom", F.concat(F.lit("chr"), "tid"))
    return simulate.landscape(contigs, 5, seed=7, germline=500, somatic_per_genome=20, genomes=50)


@query("""
SELECT cluster_id, n_segments, concat(CASE WHEN n_segments < 5 AND f <= 2.0::DOUBLE / (2 * u + 1) AND NOT (n_span >= 1 AND n_segments > 1) THEN 'soma' ELSE 'germ' END,
  '|', CASE WHEN n_te > 1 THEN 'nested' ELSE '' END) AS origin
FROM (SELECT aln_id % 30000 AS cluster_id, count(*) AS n_segments, CAST(sum(mapq) % 100 AS DOUBLE) / 100 AS f, max(lc) % 7 AS u, max(m2) % 2 AS n_span, min(m1) % 4 AS n_te FROM {aln} GROUP BY ALL)""")
def origin_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "aln").groupBy((F.col("aln_id") % 30000).alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_segments"), ((F.sum("mapq") % 100).cast("double") / 100).alias("f"), (F.max("lc") % 7).alias("u"),
        (F.max("m2") % 2).alias("n_span"), (F.min("m1") % 4).alias("n_te"),
    )
    made = legacy.origin_label(*[F.col(c) for c in ("n_segments", "f", "u", "n_span", "n_te")])
    return rows.select("cluster_id", "n_segments", made.alias("origin"))


@query("""
SELECT hit_id, CASE WHEN seg_reverse THEN CASE WHEN te >= 0.15 THEN 1.0 ELSE 0.0 END WHEN rd < 0.75 THEN 0.5
  WHEN (mq < 30 AND divergence < 0.02) OR (rd > 0.6 AND mq >= 40) OR (query_start <= 20 AND te >= 0.1 AND mq >= 30) OR (query_start > 20 AND te >= 0.25 AND mq >= 60) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_score
FROM (SELECT *, (map_len % 50)::DOUBLE / 50 AS te, (query_end % 20)::DOUBLE / 20 AS rd, score % 61 AS mq FROM {hit})""")
def legacy_hit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, n: (F.col(c) % n).cast("double") / n
    made = te_hits.legacy_hit_score(F.col("seg_reverse"), part("query_end", 20), part("map_len", 50), F.col("score") % 61, F.col("query_start"), F.col("divergence"))
    return view(spark, sf_dir, "hit").select("hit_id", made.alias("hit_score"))


@query("""
WITH e AS (SELECT cluster_id, flag % 3 * 30 AS mq, flag % 4 AS sc, flag % 5 AS te, flag % 7 AS s, flag % 6 AS l, flag % 11 % 6 AS r, flag % 13 > 6 AS rep, flag % 17 > 5 AS crowded,
  flag % 19 % 12 AS d, flag % 23 % 3 AS ss, flag % 29 % 4 AS sd, flag % 31 % 3 AS dl, flag % 37 % 3 AS dr, flag % 41 > 15 AS spanned, 20 + flag % 43 AS cov FROM {clt}),
f AS (SELECT *, CASE WHEN d >= 10 THEN 17 WHEN d >= 5 THEN CASE WHEN d::DOUBLE / cov <= 0.12 AND l > 0 AND r > 0 THEN 19 ELSE 21 END
    WHEN sd = 1 THEN CASE WHEN l + r = 1 THEN 27 WHEN l > 0 AND r > 0 THEN 23 ELSE 25 END
    WHEN l > 0 AND r > 0 AND d - (dl + dr) <= 1 THEN 29 ELSE 31 END AS amid,
  CASE WHEN l = 0 THEN CASE WHEN r >= 4 AND rep THEN 9 WHEN d >= 1 THEN 11 ELSE 39 END WHEN r = 0 THEN CASE WHEN l >= 4 AND rep THEN 13 WHEN d >= 1 THEN 15 ELSE 41 END ELSE 0 END AS bare FROM e)
SELECT cluster_id, CASE WHEN te = 0 THEN 0 WHEN mq < 60 OR sc < 1 THEN 3
  WHEN s <> 0 THEN CASE WHEN NOT rep THEN 1 WHEN ss > 0 THEN 43 WHEN l * r = 0 AND d >= 3 THEN 45 ELSE 1 END
  WHEN NOT crowded THEN CASE WHEN abs(0.5 - l::DOUBLE / nullif(l + r, 0)) > 0.5 - 0.1883698 THEN 5 ELSE 7 END
  WHEN sd = 0 THEN bare WHEN spanned THEN amid WHEN l <> 0 AND r <> 0 THEN 33 ELSE 35 END AS state FROM f""")
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flag")
    evidence = {
        "mapq": f % 3 * 30, "score": f % 4, "n_te": f % 5, "n_span": f % 7, "n_left": f % 6, "n_right": f % 11 % 6, "in_repeat": f % 13 > 6, "crowded": f % 17 > 5,
        "n_double": f % 19 % 12, "sup_span": f % 23 % 3, "sup_double": f % 29 % 4, "double_left": f % 31 % 3, "double_right": f % 37 % 3, "spanned": f % 41 > 15, "coverage": f % 43 + 20,
    }
    return view(spark, sf_dir, "clt").select("cluster_id", legacy.state_code(evidence).alias("state"))
