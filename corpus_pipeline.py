"""A corpus pipeline: toxicity, exact and near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import decontaminate, exact_dedup, ngram_join, packing, queries, toxicity
from gapline.llm.store import Scratch

#: SQL cannot express a scored filter; ``tests/llm`` holds a brute-force version of every stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the lexicon, learned from the labels outside the held-out fold, does not reject."""
    scored = toxicity.score_toxicity(docs, queries.toxicity_lexicon(spark, sf_dir))
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links join: five-word sequences, similarity 0.8."""
    return ngram_join.jaccard_dedup(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window."""
    marked = decontaminate.mark_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
