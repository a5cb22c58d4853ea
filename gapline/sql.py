"""The column functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name -> (parameters, expression).  They are plain SQL, so Spark folds them into the query's plan.
FUNCTIONS = {
    "reverse_complement": ("seq STRING", "translate(reverse(seq), 'ACGTNacgtn', 'TGCANtgcan')"),
    "subsequence": ("seq STRING, low INT, high INT", "substr(seq, greatest(0, low) + 1, greatest(0, high - greatest(0, low)))"),
    "strip_n": ("seq STRING", "nullif(replace(seq, 'N', ''), '')"),
    "cluster_key": ("tid INT, idx BIGINT", "concat_ws('-', tid, idx)"),
    "is_valid_alignment": ("flag INT", "(flag & 260) = 0"),
    "has_any": ("flag BIGINT, bits BIGINT", "(flag & bits) <> 0"),
    "has_all": ("flag BIGINT, bits BIGINT", "(flag & bits) = bits"),
    "location_type": ("n_overlap BIGINT, distance INT", "CASE WHEN n_overlap = 0 THEN 1 WHEN distance < 50 THEN 2 ELSE 4 END"),
    "cluster_type": ("n BIGINT, reads BIGINT", "CASE WHEN n = 1 THEN 1 WHEN n = 2 AND reads = 1 THEN 2 ELSE 0 END"),
    "min_edge": ("n INT", "CASE WHEN n < 5 THEN 1 WHEN n < 10 THEN 2 WHEN n < 40 THEN 3 WHEN n < 70 THEN 4 ELSE 5 END"),
}


def register(spark: SparkSession, prefix: str = "gap_") -> list[str]:
    """Make the functions available to ``spark.sql`` as temporary functions; returns their names."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
