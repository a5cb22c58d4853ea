"""Views of the driver's tables that have the shape of genomic data.

Every view is a list of select levels in the dialect that Spark and DuckDB share,
so the Spark plan and the SQL twin start from the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (table, levels of select expressions)
VIEWS: dict[str, tuple[str, list[list[str]]]] = {
    "aln": (
        "lineitem",
        [
            [
                "CAST((((l_orderkey * 1000003 + l_partkey) * 1009 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS BIGINT) AS aln_id",
                "CAST(l_suppkey % 5 AS INT) AS tid",
                "CAST((97 * l_partkey + 31 * l_orderkey) % 2000000 AS INT) AS pos",
                "CAST(l_partkey % 61 AS INT) AS mapq",
                "CAST(CASE WHEN l_returnflag = 'R' THEN 256 ELSE 0 END + 16 * (l_partkey % 2) AS INT) AS flag",
                "concat('r', CAST(l_orderkey AS STRING)) AS qname",
                "CAST(60 * (l_suppkey % 7) AS INT) AS lc",
                "CAST(500 + l_partkey % 700 AS INT) AS m1",
                "CAST(80 * (l_orderkey % 5) AS INT) AS ins",
                "CAST(300 + l_suppkey % 400 AS INT) AS m2",
                "CAST(70 * (l_partkey % 6) AS INT) AS rc",
                "CAST(l_orderkey % 90 AS INT) AS nm",
            ],
            [
                "aln_id, tid, pos, mapq, flag, qname, nm",
                "concat(CASE WHEN lc > 0 THEN concat(CAST(lc AS STRING), 'S') ELSE '' END, concat(CAST(m1 AS STRING), 'M'), "
                "CASE WHEN ins > 0 THEN concat(CAST(ins AS STRING), 'I') ELSE '' END, concat(CAST(m2 AS STRING), 'M'), "
                "CASE WHEN rc > 0 THEN concat(CAST(rc AS STRING), 'S') ELSE '' END) AS cigar",
                "lc, m1, ins, m2, rc",
            ],
        ],
    ),
    "ivl": (
        "orders",
        [
            [
                "o_orderkey AS ivl_id",
                "CAST(o_custkey % 5 AS INT) AS tid",
                "CAST((211 * o_orderkey) % 2000000 AS INT) AS i_start",
                "CAST((211 * o_orderkey) % 2000000 + 40 + o_custkey % 300 AS INT) AS i_end",
            ]
        ],
    ),
    "hit": (
        "lineitem",
        [
            [
                "l_orderkey AS seg_id",
                "CAST((((l_orderkey * 1000003 + l_partkey) * 1009 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS BIGINT) AS hit_id",
                "CAST(l_partkey % 900 AS INT) AS query_start",
                "CAST(l_partkey % 900 + 20 + l_suppkey % 180 AS INT) AS query_end",
                "CAST(l_suppkey % 7 AS INT) AS te_tid",
                "CAST(30 + l_suppkey % 180 AS INT) AS map_len",
                "CAST(l_partkey % 300 AS INT) AS score",
                "CAST(l_suppkey % 40 AS DOUBLE) / 100 AS divergence",
                "l_returnflag = 'R' AS reverse",
                "l_linestatus = 'F' AS seg_reverse",
            ]
        ],
    ),
    "site": (
        "lineitem",
        [
            [
                "CAST((((l_orderkey * 1000003 + l_partkey) * 1009 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS BIGINT) AS site_id",
                "CAST(l_suppkey % 5 AS INT) AS chrom",
                "CAST(l_orderkey * 7 + l_linenumber AS INT) AS pos",
                "CAST(l_partkey % 23 AS BIGINT) AS a1",
                "CAST(l_partkey % 19 AS BIGINT) AS a2",
                "CAST(l_suppkey % 17 AS BIGINT) AS t1",
                "CAST(l_suppkey % 13 AS BIGINT) AS t2",
                "CAST(l_orderkey % 11 AS BIGINT) AS c1",
                "CAST(l_orderkey % 7 AS BIGINT) AS c2",
                "CAST(l_linenumber AS BIGINT) AS g1",
                "CAST(l_linenumber % 3 AS BIGINT) AS g2",
            ]
        ],
    ),
    "clt": (
        "part",
        [
            [
                "p_partkey AS cluster_id",
                "CAST(p_partkey % 3 AS INT) AS clt_type",
                "CAST((p_partkey * 48271 + p_size * 131) % 33554432 AS BIGINT) AS flag",
            ]
        ],
    ),
    "ann": (
        "lineitem",
        [
            [
                "l_orderkey AS cluster_id",
                "CAST((((l_orderkey * 1000003 + l_partkey) * 1009 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS BIGINT) AS ann_id",
                "CAST(l_suppkey % 9 AS INT) - 2 AS tid",
                "CAST(l_partkey % 2000 AS INT) AS query_start",
                "CAST(l_partkey % 2000 + 50 + l_suppkey % 90 AS INT) AS query_end",
                "l_returnflag = 'R' AS reverse",
                "CAST(CASE WHEN l_suppkey % 9 < 2 THEN 0 ELSE l_orderkey % 600 END AS INT) AS ref_start",
                "CAST(CASE WHEN l_suppkey % 9 < 2 THEN 0 ELSE l_orderkey % 600 + 70 END AS INT) AS ref_end",
                "concat('TE', CAST(l_suppkey % 9 - 2 AS STRING)) AS te_name",
            ]
        ],
    ),
    "dna": (
        "documents",
        [
            ["doc_id", "translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTAACGTT') AS raw"],
            ["doc_id", "regexp_replace(raw, '[^ACGT]', 'N'%G) AS seq"],
        ],
    ),
    "ord": (
        "orders",
        [
            [
                "o_orderkey AS ord_id",
                "CAST(o_custkey % 5 AS INT) AS chrom",
                "CAST(o_orderkey AS INT) AS pos",
                "o_totalprice AS measure",
                "CAST(o_custkey % 101 AS DOUBLE) / 202 AS strand_bias",
                "o_orderpriority = '1-URGENT' AS is_outlier",
                "o_orderstatus",
                "o_custkey",
            ]
        ],
    ),
}


def _level(expressions: list[str], duck: bool) -> list[str]:
    """DuckDB replaces all matches of a pattern only when told so."""
    return [e.replace("%G", ", 'g'" if duck else "") for e in expressions]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, levels = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for level in levels:
        df = df.selectExpr(*[part for e in _level(level, False) for part in (e.split(", ") if " AS " not in e else [e])])
    return df


def view_sql(name: str) -> str:
    """A parenthesised subquery of the view."""
    table, levels = VIEWS[name]
    sql = table
    for k, level in enumerate(levels):
        sql = f"(SELECT {', '.join(_level(level, True))} FROM {sql}{' AS q' + str(k) if k else ''})"
    return sql
