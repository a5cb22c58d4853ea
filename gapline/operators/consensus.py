"""Homopolymer correction and column consensus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions.cigar import aligned_pairs
from gapline.functions.sequences import homopolymer_runs


def run_length_vote(observed: DataFrame, *, key: Sequence[str], length: str = "length", reference: str = "ref_length") -> DataFrame:
    """The corrected length of each run: the most common other length if strictly more reads have it than the reference's.

    Ties among other lengths go to the smaller.  ``observed`` has a row for each read and run.
    """
    counts = observed.groupBy(*key, reference, length).agg(F.count(F.lit(1)).alias("n"))
    other = F.col(length) != F.col(reference)
    best = F.max(F.when(other, F.struct(F.col("n").alias("n"), (-F.col(length)).alias("l"))))
    same = F.coalesce(F.max(F.when(~other, F.col("n"))), F.lit(0))
    made = counts.groupBy(*key, reference).agg(best.alias("best"), same.alias("same"))
    new = F.when(F.coalesce(F.col("best.n"), F.lit(0)) > F.col("same"), -F.col("best.l")).otherwise(F.col(reference))
    return made.select(*key, reference, new.alias("new_length"), (new != F.col(reference)).alias("changed"))


def base_vote(columns: DataFrame, *, key: Sequence[str], base: str = "base", reference: str = "ref_base") -> DataFrame:
    """The most common base of each column; on a tie the reference's if it takes part, else the first letter."""
    counts = columns.groupBy(*key, reference, base).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((-F.col("n")).alias("n"), (F.col(base) != F.col(reference)).alias("other"), F.col(base).alias("base"))
    made = counts.groupBy(*key, reference).agg(F.min(rank).alias("best"), F.sum("n").alias("depth"))
    return made.select(*key, reference, F.col("best.base").alias("consensus"), (-F.col("best.n")).alias("n"), "depth")


def skip_next(regions: Column) -> Column:
    """Which regions of an ordered array are corrected: the one behind a changed region is left as it is.

    ``regions`` is an array of booleans (would change); the result has the same length.
    """
    zero = F.struct(F.lit(False).alias("skip"), F.array().cast("array<boolean>").alias("out"))

    def step(state: Column, change: Column) -> Column:
        done = change & ~state["skip"]
        return F.struct(done.alias("skip"), F.concat(state["out"], F.array(done)).alias("out"))

    return F.aggregate(regions, zero, step, lambda s: s["out"])


def nearest_aligned(pairs: DataFrame, *, key: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """For each column of an alignment the nearest positions before and behind with both sides aligned."""
    both = F.when((F.col("query") >= 0) & (F.col("ref") >= 0), F.struct("query", "ref"))
    order = Window.partitionBy(*key).orderBy(ordinal)
    before = F.last(both, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(both, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return pairs.withColumns({"before": before, "behind": behind})


def insertion_consensus(columns: DataFrame, *, key: Sequence[str], inserted: str = "inserted", min_share: float = 0.5) -> DataFrame:
    """The most common inserted string of each column if at least ``min_share`` of its reads have an insertion."""
    counts = columns.groupBy(*key, inserted).agg(F.count(F.lit(1)).alias("n"))
    has = F.col(inserted) != ""
    best = F.min(F.when(has, F.struct((-F.col("n")).alias("n"), F.col(inserted).alias("s"))))
    made = counts.groupBy(*key).agg(best.alias("best"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("with"), F.sum("n").alias("depth"))
    kept = F.when(F.col("with") >= min_share * F.col("depth"), F.col("best.s"))
    return made.select(*key, F.coalesce(kept, F.lit("")).alias("insertion"), "depth")


def run_observations(pairs: DataFrame, runs: DataFrame, reads: DataFrame) -> DataFrame:
    """What each read says about each run of its contig: (contig, run_start, read_id, text, length, voted).

    ``pairs`` has contig, read_id, ordinal, query and ref of the aligned pairs (-1
    for gaps), ``runs`` contig, run_start, run_end (exclusive) and base, ``reads``
    read_id and seq.  The stretch of the read begins behind the nearest aligned
    column before the run, or, if the run's first base is deleted, at the next
    aligned one within the run; likewise at the end.  ``voted`` is its length, one
    more if it equals the run's and the read has the same base once more before it.
    """
    both = F.when((F.col("query") >= 0) & (F.col("ref") >= 0), F.struct("query", "ref"))
    order = Window.partitionBy("contig", "read_id").orderBy("ordinal")
    near = pairs.withColumns(
        {
            "left": F.last(both, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "right": F.first(both, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).filter("ref >= 0")
    here, last = F.col("query") >= 0, F.col("run_end") - 1
    begin = F.when(here, F.coalesce(F.col("left.query") + 1, F.col("query"))).otherwise(F.when(F.col("right.ref") <= last, F.col("right.query")))
    end = F.when(here, F.coalesce(F.col("right.query"), F.col("query") + 1)).otherwise(F.when(F.col("left.ref") >= F.col("run_start"), F.col("left.query") + 1))
    gone = ~here & (F.col("run_start") == last)
    keys = ["contig", "read_id", "run_start"]
    starts = near.join(runs.withColumn("ref", F.col("run_start")), ["contig", "ref"]).select(
        *keys, "run_end", "base", F.when(gone, 0).otherwise(begin).alias("a"), gone.alias("gone")
    )
    ends = near.join(runs.withColumn("ref", last), ["contig", "ref"]).select(*keys, F.when(gone, 0).otherwise(end).alias("b"))
    size = F.col("b") - F.col("a")
    before = F.substr("seq", F.col("a"), F.lit(1))
    once_more = ~F.col("gone") & (F.col("a") > 0) & (size == F.col("run_end") - F.col("run_start")) & (before == F.col("base"))
    found = starts.join(ends, keys).filter("a is not null and b is not null and b >= a").join(reads.select("read_id", "seq"), "read_id")
    return found.select(
        "contig", "run_start", "run_end", "base", "read_id", F.substr("seq", F.col("a") + 1, size).alias("text"), size.alias("length"),
        (size + once_more.cast("int")).alias("voted"),
    )


def recalibrate(contigs: DataFrame, reads: DataFrame, pairs: DataFrame, longest: int = 20) -> DataFrame:
    """Contigs (contig, seq) whose homopolymer runs have the length and bases that most reads show.

    Runs of more than ``longest`` bases and runs without reads stay.  The run
    behind one whose length changed stays too.
    """
    runs = contigs.select("contig", F.posexplode_outer(homopolymer_runs(F.col("seq"))).alias("k", "r")).filter("r is not null")
    runs = runs.select("contig", "k", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"), F.col("r.base").alias("base"))
    seen = run_observations(pairs, runs.filter(F.col("run_end") - F.col("run_start") <= longest).drop("k"), reads)
    key = ["contig", "run_start"]
    votes = run_length_vote(seen.withColumn("ref_length", F.col("run_end") - F.col("run_start")).withColumn("length", F.col("voted")), key=key)
    fitting = seen.join(votes.select(*key, "new_length"), key).filter(F.col("length") == F.col("new_length"))
    columns = fitting.select(*key, "base", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("place", "letter"))
    bases = base_vote(columns, key=[*key, "place"], base="letter", reference="base")
    text = bases.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "consensus"))), lambda x: x["consensus"]), "").alias("new_text"))
    made = runs.join(votes, key, "left").join(text, key, "left")
    old = F.repeat("base", F.col("run_end") - F.col("run_start"))
    eligible = F.col("new_length").isNotNull()
    # a run that should vanish does; one whose length no read has stays
    new = F.when(F.col("new_length") == 0, "").otherwise(F.coalesce("new_text", old))
    changed = eligible & (F.col("changed") & ((F.col("new_length") == 0) | F.col("new_text").isNotNull()))
    rows = made.groupBy("contig").agg(
        F.array_sort(F.collect_list(F.struct("k", eligible.alias("ok"), F.coalesce(changed, F.lit(False)).alias("changed"), old.alias("old"), new.alias("new")))).alias("rows")
    )
    zero = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        use = x["ok"] & ~state["skip"]
        skip = F.when(x["ok"], use & x["changed"]).otherwise(state["skip"])
        return F.struct(skip.alias("skip"), F.concat(state["out"], F.array(F.when(use, x["new"]).otherwise(x["old"]))).alias("out"))

    return rows.select("contig", F.array_join(F.aggregate("rows", zero, step, lambda s: s["out"]), "").alias("seq"))


def pileup_columns(alignments: DataFrame, *, key: Sequence[str], ops: Column, pos: str = "pos", seq: str = "seq") -> DataFrame:
    """A row for each reference column of each alignment: ref, base (empty for a deletion), inserted (bases that follow)."""
    rows = alignments.select(*key, F.col(seq).alias("seq"), F.posexplode_outer(aligned_pairs(ops, F.col(pos))).alias("ordinal", "p")).filter("p is not null")
    rows = rows.select(*key, "seq", "ordinal", F.col("p.query").alias("query"), F.col("p.ref").alias("ref"))
    order = Window.partitionBy(*key).orderBy("ordinal")
    column = F.last(F.when(F.col("ref") >= 0, F.col("ref")), ignorenulls=True).over(order)
    letter = F.when(F.col("query") >= 0, F.substr("seq", F.col("query") + 1, F.lit(1))).otherwise("")
    parts = rows.select(*key, "ordinal", "ref", column.alias("column"), letter.alias("letter")).filter("column is not null")
    made = parts.groupBy(*key, "column").agg(
        F.max(F.when(F.col("ref") >= 0, F.col("letter"))).alias("base"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ref") < 0, F.struct("ordinal", "letter")))), lambda x: x["letter"]), "").alias("inserted"),
    )
    return made.withColumnRenamed("column", "ref")


def _common_stretch(rows: Sequence[str], begin: int, end: int) -> str:
    """The ungapped text of columns begin to end that most rows show; the longer one on ties, then the first seen."""
    counts = Counter(row[begin : end + 1].replace("-", "") for row in rows)
    ranked = sorted(counts.items(), key=lambda x: (-x[1], -len(x[0])))
    return ranked[1][0] if not ranked[0][0] and len(ranked) > 1 else ranked[0][0]


def anchor_consensus(rows: Sequence[str], tail: int = 15, span: int = 3) -> str:
    """Consensus of aligned rows of equal length, without the last ``tail`` columns.

    Columns are voted on one by one.  Where all bases agree the column is an anchor,
    and the stretch since the anchor before is decided anew as a whole: by the text
    that most rows show over the last ``span`` anchors, if it continues what was
    decided, else by the text since the anchor before.
    """
    out: list[str] = []
    anchors: list[int] = []
    for i in range(max(0, min(map(len, rows)) - tail) if rows else 0):
        column = Counter(row[i] for row in rows)
        (top, n), (second, m) = sorted(((b, column[b]) for b in "ATCG-"), key=lambda x: -x[1])[:2]
        if top == "-":
            out.append(second if 2 * m >= n else "-")
            continue
        if sum(column.values()) - column["-"] > n:
            out.append(top)
            continue
        anchors.append(i)
        if len(anchors) == 1:
            out.append(top)
            continue
        begin, before = anchors[-span:][0], anchors[-2]
        decided = "".join(out[begin : before + 1]).replace("-", "")
        stretch = _common_stretch(rows, begin, i)
        new = stretch[len(decided) :] if stretch.startswith(decided) else _common_stretch(rows, before, i)[1:]
        out[before + 1 :] = ["-"] * (i - before - len(new)) + list(new)
    return "".join(out).replace("-", "")


def anchor_consensus_table(aligned: DataFrame, *, key: str = "cluster_id", row: str = "aligned") -> DataFrame:
    """(key, consensus) of the aligned rows of each cluster; a cluster is one task's work."""
    kind = aligned.schema[key].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: part[key].iloc[:1], "consensus": [anchor_consensus(sorted(part[row]))]})

    return aligned.select(key, row).groupBy(key).applyInPandas(one, f"`{key}` {kind}, consensus string")
