from __future__ import annotations

import hashlib
import random

import pytest

from gapline.llm.exact_dedup import DigestIndex, exact_dedup


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    keep = {k: min(v, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)) for k, v in groups.items()}
    return sorted(
        (i is None, i or 0, keep[k][0], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [norm(t)]
    )


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab \t\n\u00a0é") for _ in range(rng.randint(0, 5)))) for i in range(600)]
    rows += [(1000 + i, "hot  text" if i % 3 else "hot text") for i in range(400)] + [(2000, None), (2001, ""), (None, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = DigestIndex(spark).add(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup(df).collect()
    assert sorted((r.doc_id or -1) for r in kept) == sorted((r.doc_id or -1) for r in got if r.kept)


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a", "x")] * 3 + [(2, "a b", "y")], "doc_id long, text string, kept string")
    assert [r.kept for r in DigestIndex(spark).add(df).collect()].count(True) == 2
    assert sorted(exact_dedup(df).collect()) == [(1, "a", "x"), (2, "a b", "y")]


def test_second_batch_meets_the_index(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert DigestIndex(spark, at, 4).add(first).filter("kept").count() == 2
    second = spark.createDataFrame([(3, " a "), (4, "c")], "doc_id long, text string")
    again = DigestIndex(spark, at, 4)
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in again.add(second).collect()}
    assert got == {3: (1, False, 2), 4: (4, True, 1)}
    assert again.table().count() == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert DigestIndex(spark).add(df).count() == 0
    assert exact_dedup(df).count() == 0


def test_reopened_index_keeps_its_buckets(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert DigestIndex(spark, at, 4).add(df).filter("kept").count() == 200
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = DigestIndex(spark, at)
            assert again.buckets == 4
            assert again.add(df).filter("kept").count() == 0
            assert again.table().count() == 200
            again.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, at, 8)


def test_a_batch_added_again_gives_the_same(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    index = DigestIndex(spark, at, 4)
    index.add(spark.createDataFrame([(0, "old")], "doc_id long, text string"), batch="a")
    rows = [(1, "old"), (2, "b"), (3, "b "), (4, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # an attempt that got as far as part of the batch
    index.add(df.filter("doc_id in (2, 3)"), batch="b")
    index.close()
    for _ in range(2):
        again = DigestIndex(spark, at)
        got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in again.add(df, batch="b").collect()}
        assert got == {1: (0, False, 2), 2: (3, False, 2), 3: (3, True, 2), 4: (4, True, 1)}
        assert again.table().count() == 3
        again.close()
    assert not [t for t in spark.catalog.listTables() if t.name == again.name]


def test_very_long_texts_and_clashing_names(spark):
    rows = [(1, "x " * 1_000_000, 1, 2), (2, "x" * 1_000_000, 3, 4), (None, "y", 5, 6), (None, None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __digest int, __key int")
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["__digest"], r["__key"]) for r in kept.collect()) == [(1, 2), (5, 6), (7, 8)]
