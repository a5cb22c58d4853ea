from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gapline.llm import ngram_join, sketch
from gapline.llm.ngram_join import Classes, combinations, jaccard_components, jaccard_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=85, shingle=4):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)], links[k]) for k, (i, _) in enumerate(rows))


def got(df, **kw):
    found = jaccard_components(df, links=True, **kw)
    return sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "n_links").collect())


def corpus(rng, bases, copies, words):
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [f"v{rng.random()}"], [own[at], "X"]])
                own = own or ["z"]
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(i, t.upper() if i % 7 == 0 else t) for i, t in enumerate(rows)]


def planned(rng):
    rows = corpus(rng, 25, 14, (3, 90)) + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c"), (1005, "a b c")]
    rows += [(1100 + i, " ".join("abc"[(i + k) % 3] for k in range(6 + i % 3))) for i in range(12)]
    boilerplate = " ".join(f"b{k}" for k in range(40))  # in many texts, and most of some
    rows += [(1200 + i, f"{boilerplate} {' '.join(f'o{rng.randint(0, 20)}' for _ in range(i % 9))}") for i in range(40)]
    return rows


#: Shares of frequent and of very frequent elements: all rare, only pairs, only triples, any.
@pytest.mark.parametrize(("often", "hot", "percent", "shingle"), [(0, 0, 85, 4), (1, 0, 85, 4), (0, 1, 80, 5), (0.5, 0.5, 80, 5), (0.7, 0.4, 67, 3)])
def test_against_brute_force(spark, monkeypatch, often, hot, percent, shingle):
    width = 1 << 10
    bits = np.random.default_rng(1).random((2, width)) < [[often], [hot]]
    bits[0] |= bits[1]
    classes = Classes(tuple(np.packbits(b, bitorder="little") for b in bits), width)
    monkeypatch.setattr(ngram_join, "token_classes", lambda *_: classes)
    rows = planned(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, percent=percent, shingle=shingle) == brute(rows, percent, shingle)


def test_classes_by_the_sketch_and_ids_that_meet(spark, monkeypatch):
    for name, value in (("FREQUENT", 3), ("MORE", 3), ("TIMES", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = planned(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, id_bits=5) == brute(rows)


@pytest.mark.parametrize("percent", [67, 70, 80, 85, 90, 95])
def test_linked_sets_have_a_combination_in_common(percent):
    rng = np.random.default_rng(percent)
    width = 1 << 8
    for _ in range(1500):
        often, hot = rng.random(), rng.random()
        bits = rng.random((2, width)) < [[often], [hot]]
        bits[0] |= bits[1]
        classes = Classes(tuple(np.packbits(b, bitorder="little") for b in bits), width)
        total = int(rng.integers(2, 60 if rng.random() < 0.7 else 12))
        all_ = np.unique(rng.integers(0, 1 << 63, total, dtype=np.uint64))
        apart = int(rng.integers(1, max(2, total * (100 - percent) // 100 + 1)))
        out = rng.permutation(len(all_))[:apart]
        cut = int(rng.integers(0, apart + 1))
        a, b = np.delete(all_, out[:cut]), np.delete(all_, out[cut:])
        both = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        signs = [{(int(x), k) for xs, k in combinations(s, classes, percent)[0] for x in xs} for s in (a, b)]
        assert signs[0] & signs[1]


def test_large_list_in_blocks(spark, monkeypatch):
    for name, value in (("SIDE", 8), ("LINK_SIDE", 8), ("LINK_ELEMENTS", 500), ("VERIFY", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    rows = corpus(rng, 2, 90, (30, 60))
    rows += [(900 + k, " ".join(f"chain{j}" for j in range(k, k + 60))) for k in range(0, 60, 2)]  # linked in a chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_texts_of_two_words_in_the_order_of_thue_and_morse(spark):
    order = [bin(k).count("1") % 2 for k in range(2048)]
    rows = [(1, "".join("ab"[x] for x in order)), (2, "".join("ba"[x] for x in order))]
    rows += [(3, " ".join("ab"[x] for x in order)), (4, " ".join("ba"[x] for x in order)), (5, " ".join("cd"[x] for x in order))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_rows_without_ids_stay_apart_and_the_largest_id_is_one(spark):
    # pairs of texts that a 32-bit hash of strings cannot tell apart would be lost with it as identity
    rows = [(None, f"text {k} of its own kind {k * k}") for k in range(200)] + [((1 << 63) - 1, "the last one"), (None, "the last one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __doc", "2 AS __nil", "3 AS nil", "4 AS sid")
    kept = jaccard_dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == 201 and kept.filter("doc_id is not null").count() == 1
    found = jaccard_components(df).filter("doc_id is not null").first()
    assert found.component_id == (1 << 63) - 1


def test_very_long_text(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words[:-10]])), (3, " ".join(words[:60_000])), (4, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_dedup_keeps_the_first_and_the_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text, "a"), (1, text + " end", "b"), (2, "other", "c"), (4, None, "d"), (None, text, "e"), (2, "other", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    assert sorted((r.doc_id, r.n) for r in jaccard_dedup(df).collect()) == [(1, "b"), (2, "c"), (4, "d")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).count() == 0
    assert jaccard_dedup(df).count() == 0


def test_a_piece_of_texts_is_hashed_at_once(monkeypatch):
    rng = random.Random(7)
    rows = [None, "", "a B", "a  b", *(" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 60))) for _ in range(400))]
    calls = []
    mix = ngram_join.mix
    monkeypatch.setattr(ngram_join, "mix", lambda x: calls.append(len(x)) or mix(x))
    nothing = pa.nulls(len(rows), pa.int64())
    batch = pa.RecordBatch.from_arrays([nothing] * 4 + [pa.array(rows)], names=["nil", "doc", "t1", "t2", "text"])
    out = [x for x in ngram_join._describe(iter([batch]), 4, 64, 1 << 10) if x.column("segment").null_count]
    assert len(calls) <= 6  # three for each text before
    words = [tuple(WORD.findall((t or "").translate(FOLD))) for t in rows]
    sets = [{w[k : k + 4] for k in range(max(1, len(w) - 3))} if w else set() for w in words]
    assert out[0].column("n").to_pylist() == [len(s) for s in sets]
    ids = list(zip(out[0].column("raw").to_pylist(), out[0].column("check").to_pylist(), strict=True))
    assert len(set(ids)) == len({frozenset(s) for s in sets}) == len({(i, frozenset(s)) for i, s in zip(ids, sets, strict=True)})


def test_the_sketch_sorts_each_key_once(monkeypatch):
    monkeypatch.setattr(sketch, "STEP", 500)
    rng, width, depth = np.random.default_rng(8), 1 << 16, 2
    keys = [rng.integers(0, 20_000, 100, dtype=np.uint64) for _ in range(200)]
    given = []
    unique = np.unique
    monkeypatch.setattr(sketch.np, "unique", lambda x, **kw: given.append(len(x)) or unique(x, **kw))
    made = sketch.Partial(depth, width)
    found = [x for k in keys for x in made.add(k)] + list(made.rest())
    assert sum(given) == depth * 200 * 100  # what was held already was sorted again at each step before
    counts = np.zeros(depth * width, np.int64)
    for segments, packed in found:
        for segment, data in zip(segments, packed, strict=True):
            at, n = sketch.unpack(data)
            counts[segment * sketch.SEGMENT + at] += n
    every = np.concatenate(keys)
    expected = sum(np.bincount(sketch.cells(every, row, width), minlength=depth * width) for row in range(depth))
    assert (counts == expected).all()
