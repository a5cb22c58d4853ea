"""Queries that read whole texts and whole tables, on rows that only the rest of them holds."""

from __future__ import annotations

import __spark_entry__ as driver


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_runs_behind_the_first_400_bases(spark, tmp_path):
    where = documents(spark, tmp_path, [(1, "bc" * 300 + "aaaa" + "bc" * 10), (2, "ddd"), (3, None)])
    got = driver.queries()["homopolymer_runs"](spark, where).collect()
    assert sorted(map(tuple, got)) == [(1, 600, 604, "A"), (2, 0, 3, "T")]


def test_tails_behind_the_first_60_bases(spark, tmp_path):
    where = documents(spark, tmp_path, [(25, "bc" * 50 + "a" * 30 + "bc" * 20), (50, "bc" * 10)])
    got = driver.queries()["poly_tail_scan"](spark, where).collect()
    assert [(r.doc_id, r.tail_start, r.tail_end) for r in got] == [(25, 100, 130)]


def test_long_and_short_pileup_strings(spark, tmp_path):
    where = documents(spark, tmp_path, [(1, "abcd!" * 30), (2, "abc"), (3, "")])
    got = driver.queries()["pileup_strings"](spark, where).collect()
    assert sorted(map(tuple, got)) == [(1, ".,GTN" * 30, 120), (2, ".,G", 2), (3, "", 0)]


def test_intervals_outside_the_former_subsets_count(spark, tmp_path):
    """One alignment and one interval over it, whose number no subset has."""
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    line = [(1, 57, 5, 1, 1.0, "N", "O")]  # tid 0, pos 5560, mapq 57
    spark.createDataFrame(line, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = [(26, 95)]  # tid 0, 5486 to 5621
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: driver.queries()[name](spark, str(tmp_path)).collect()
    assert [(r.n_truth, r.truth_id) for r in run("truth_label")] == [(1, 26)]
    assert [r.ivl_id for r in run("support_label")] == [26]
    assert run("not_in_repeats") == [] and run("blacklist_anti") == []
    assert len(run("blacklist_semi")) == 1


def test_reads_beyond_a_batch_are_assembled(spark):
    from gapline.ext import GreedyAssembler

    rows = [(1, "A" * 30 + "C" * 30), (1, "G" * 50), (1, "T" * 40), (1, "C" * 20 + "GA" * 9)]
    df = spark.createDataFrame(rows, "cluster_id long, seq string")
    got = GreedyAssembler(max_reads=2).assemble(df).collect()
    assert {r.seq for r in got} == {"A" * 30 + "C" * 30 + "GA" * 9, "G" * 50, "T" * 40}
