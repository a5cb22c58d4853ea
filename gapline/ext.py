"""Boundaries to tools and models that are not part of the library."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.operators.clusters import cluster_by_gap


class Aligner(Protocol):
    """Maps queries (id, seq) to targets (id, seq)."""

    def align(self, queries: DataFrame, targets: DataFrame) -> DataFrame:
        """Hits: query_id, target_id, query_start, query_end, ref_start, ref_end, reverse, map_len, score, divergence."""


class Scorer(Protocol):
    """Maps a DataFrame of features to a column of probabilities."""

    def __call__(self, features: DataFrame) -> Column: ...


class Assembler(Protocol):
    """Maps reads (cluster_id, seq) to contigs (cluster_id, contig, seq)."""

    def assemble(self, reads: DataFrame) -> DataFrame: ...


class LogisticScorer:
    """A transparent scorer: a logistic function of weighted feature columns."""

    def __init__(self, weights: dict[str, float], bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def __call__(self, features: DataFrame) -> Column:
        total = F.lit(self.bias)
        for name, weight in self.weights.items():
            total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
        return 1 / (1 + F.exp(-total))


DEFAULT_SCORER = LogisticScorer({"num_seg_norm": 4.0, "aligned_frac": 2.0, "entropy": 1.0, "mean_divergence": -0.5, "low_mapq_frac": -2.0}, -2.0)


class KmerAligner:
    """Ungapped hits by shared k-mers: an equi-join on k-mers, then runs on one diagonal.

    Meant for tests and small inputs; a real aligner implements the same protocol.
    """

    def __init__(self, k: int = 15, gap: int = 30):
        self.k, self.gap = k, gap

    def _kmers(self, df: DataFrame, side: str) -> DataFrame:
        seq, n = F.col("seq"), F.char_length("seq") - self.k
        rows = df.filter(n >= 0).select(F.col("id").alias(f"{side}_id"), F.char_length("seq").alias(f"{side}_len"), "seq", F.explode(F.sequence(F.lit(0), n)).alias(f"{side}_at"))
        return rows.select(f"{side}_id", f"{side}_len", f"{side}_at", F.substr(seq, F.col(f"{side}_at") + 1, F.lit(self.k)).alias("kmer"))

    def align(self, queries: DataFrame, targets: DataFrame) -> DataFrame:
        flipped = queries.withColumn("seq", F.translate(F.reverse("seq"), "ACGT", "TGCA"))
        both = self._kmers(queries, "q").withColumn("reverse", F.lit(False)).unionByName(self._kmers(flipped, "q").withColumn("reverse", F.lit(True)))
        pairs = both.join(self._kmers(targets, "t"), "kmer").withColumn("diagonal", F.col("t_at") - F.col("q_at"))
        keyed = pairs.withColumn("line", F.concat_ws("|", "q_id", "t_id", "reverse", "diagonal"))
        runs = cluster_by_gap(keyed, group="line", pos="q_at", gap=self.gap)
        made = runs.groupBy("line", "cluster_idx").agg(
            F.first("q_id").alias("query_id"), F.first("t_id").alias("target_id"), F.first("reverse").alias("reverse"), F.first("q_len").alias("q_len"),
            F.min("q_at").alias("a"), (F.max("q_at") + self.k).alias("b"), F.min("t_at").alias("ref_start"), (F.max("t_at") + self.k).alias("ref_end"),
            F.count(F.lit(1)).alias("score"),
        )
        size, back = F.col("b") - F.col("a"), F.col("reverse")
        return made.select(
            "query_id",
            "target_id",
            F.when(back, F.col("q_len") - F.col("b")).otherwise(F.col("a")).alias("query_start"),
            F.when(back, F.col("q_len") - F.col("a")).otherwise(F.col("b")).alias("query_end"),
            "ref_start",
            "ref_end",
            "reverse",
            size.alias("map_len"),
            F.col("score").cast("int").alias("score"),
            (1.0 - F.least(F.lit(1.0), F.col("score") / (size - self.k + 1))).alias("divergence"),
        )


class GreedyAssembler:
    """Contigs of each cluster by greedy overlaps, in rounds with a falling minimum; the longest read if none overlap.

    A cluster is one task's work.  Its reads come by length, ``max_reads`` at a time, each
    batch joined with the contigs of those before.
    """

    def __init__(self, rounds: int = 5, overlap: int = 50, max_reads: int = 200):
        self.rounds, self.overlap, self.max_reads = rounds, overlap, max_reads

    def assemble(self, reads: DataFrame) -> DataFrame:
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            order = lambda s: (-len(s), s)
            reads, seqs = sorted(set(rows["seq"]), key=order), []
            for at in range(0, len(reads), self.max_reads):
                seqs = sorted({*seqs, *reads[at : at + self.max_reads]}, key=order)
                for k in range(self.rounds):
                    seqs = _merge(seqs, max(10, self.overlap // 2**k))
                    if len(seqs) == 1:
                        break
            cluster = rows["cluster_id"].iloc[0]
            return pd.DataFrame([(cluster, i, s) for i, s in enumerate(seqs)], columns=["cluster_id", "contig", "seq"])

        kind = reads.schema["cluster_id"].dataType.simpleString()
        return reads.select("cluster_id", "seq").groupBy("cluster_id").applyInPandas(one, f"cluster_id {kind}, contig int, seq string")


def _merge(seqs: list[str], overlap: int) -> list[str]:
    """Joins a sequence's end to another's beginning while they share ``overlap`` bases."""
    seqs = [s for i, s in enumerate(seqs) if not any(s in t for t in seqs[:i])]
    joined = True
    while joined:
        joined = False
        for i, a in enumerate(seqs):
            for j, b in enumerate(seqs):
                if i == j:
                    continue
                at = a.find(b[:overlap])
                while at >= 0 and a[at:] != b[: len(a) - at]:
                    at = a.find(b[:overlap], at + 1)
                if at >= 0 and len(b) > len(a) - at:
                    seqs = [s for k, s in enumerate(seqs) if k not in (i, j)] + [a + b[len(a) - at :]]
                    joined = True
                    break
            if joined:
                break
    return sorted(seqs, key=lambda s: (-len(s), s))

