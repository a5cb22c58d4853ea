from __future__ import annotations

import random
import re

import numpy as np
import pytest

from gapline.llm import sketch
from gapline.llm.substring_dedup import DEPTH, document_sketch, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def got(df, **kw):
    found = substring_dedup(df, **kw).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted(tuple(r) for r in found)


@pytest.mark.parametrize("widest", [1 << 28, 1 << 10])
def test_against_brute_force(spark, widest):
    rng = random.Random(7)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randint(8, 60))] for _ in range(6)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500 + i, "x " * rng.randint(0, 80)) for i in range(20)] + [(600, None), (601, ""), (602, " é\x1c" * 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, window=12, widest=widest) == brute(rows, 12)


def test_one_long_text_and_hot_passage(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)] + [(1000, " ".join(f"w{k % 997}" for k in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows, 50)


def test_repeated_rows_clashing_names_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(70))
    rows = [(1, text, 5, "doc"), (1, text, 5, "doc"), (2, text, 6, "at"), (None, text, 7, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, cell string")
    out = substring_dedup(df)
    assert out.columns == ["doc_id", "text", "cell", "n_words", "n_removed", "kept_text"]
    assert sorted((r.doc_id or 9, r.n_removed) for r in out.collect()) == [(1, 0), (1, 0), (2, 70), (9, 70)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("width", [1 << 6, 1 << 18])
def test_estimates_never_fall_below_the_number_of_documents(spark, width):
    rng = random.Random(3)
    rows = [(doc, doc % 3, 5, rng.randint(1, 400)) for doc in range(300) for _ in range(20)]
    rows = [(low, 0, 0, doc, t1, t2, 0, 1) for doc, t1, t2, low in rows]
    df = spark.createDataFrame(rows, "low long, r1 long, r2 long, doc long, t1 long, t2 long, at int, n int").repartition(7, "doc")
    made = np.zeros(-(-DEPTH * width // sketch.SEGMENT) * sketch.SEGMENT, np.int64)
    for row in document_sketch(df, width).collect():
        at, n = sketch.unpack(bytes(row["cells"]))
        made[row["segment"] * sketch.SEGMENT + at] += n
    assert made.sum() == DEPTH * len({(r[0], r[3]) for r in rows})  # partial sketches were added up
    for low in range(1, 401):
        key = np.array([low], np.uint64)
        estimate = min(made[sketch.cells(key, row, width)[0]] for row in range(DEPTH))
        assert estimate >= len({r[3] for r in rows if r[0] == low})


def test_texts_of_two_words_in_the_order_of_thue_and_morse(spark):
    """Regular sequences, which a polynomial modulo a power of two cannot tell apart."""
    order = [bin(k).count("1") % 2 for k in range(2048)]
    rows = [(1, " ".join("ab"[x] for x in order)), (2, " ".join("ba"[x] for x in order)), (3, " ".join("cd"[x] for x in order))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, window=1024) == brute(rows, 1024)
    rows = [(1, "".join("ab"[x] for x in order) + " x" * 60), (2, "".join("ba"[x] for x in order) + " x" * 60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_rows_without_ids_keep_their_own_words(spark):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, shared), (None, f"a b c {shared} d"), (None, f"x {shared} y z"), (None, "few words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("*", "'own' AS __doc", "7 AS __ranges", "8 AS t1", "9 AS __bits")
    found = substring_dedup(df)
    assert {(r["__doc"], r["__ranges"], r["t1"], r["__bits"]) for r in found.collect()} == {("own", 7, 8, 9)}
    assert sorted(r.kept_text for r in found.filter("doc_id is null").collect()) == ["", "a b c d", "few words", "x y z"]
