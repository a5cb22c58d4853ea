from __future__ import annotations

import hashlib
import random
import re

import pytest

from gapline.llm.decontaminate import mark_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=10):
    owners = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(FOLD))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        hit, own = [False] * len(w), set()
        for key, ids in owners.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit[k : k + len(key)] = [True] * len(key)
                    own |= ids
        names = ",".join(sorted(map(str, own)))
        out.append((i, len(w), sum(hit), len(own), hashlib.sha256(names.encode()).hexdigest(), any(hit)))
    return sorted(out)


@pytest.mark.parametrize("share", [1 << 20, 60])
def test_against_brute_force(spark, share):
    rng = random.Random(6)
    words = ["a", "b", "é", "Zz", "7", "x1"]
    text = lambda n: rng.choice([" ", "-", "\n", "..."]).join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 9, 10, 11, 14]))) for k in range(8)] + [(20, None), (21, "")]
    items += [(22, items[5][1]), (22, items[5][1]), (23, items[6][1])]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(90, None), (91, "")]
    docs += [(100 + k, f"Intro, {t} end {t}") for k, t in items if t]
    docs += [(300, f"{'filler word ' * 60_000}{items[4][1]}"), docs[3], docs[-1]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = mark_contaminated(d, b, share=share).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(docs, items)


def test_offsets_lead_back_to_the_text(spark):
    item = "one two three four five six seven eight nine ten"
    doc = "É! One, two;three four FIVE six seven eight nine ten é. Other one two"
    d = spark.createDataFrame([(1, doc, 3)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    row = mark_contaminated(d, b).first()
    (span,) = row.hit_bytes
    assert doc.encode()[span.start : span.end].decode() == "One, two;three four FIVE six seven eight nine ten"
    assert row.n_hit == 10


@pytest.mark.parametrize("share", [1 << 20, 50])
def test_items_named_by_words_and_clashing_columns(spark, share):
    items = [("q-b", "one two three four five six seven eight nine ten"), ("q-a", "two three four five six seven eight nine ten end"), ("q", "else")]
    docs = [(1, f"so {items[0][1]} end", 1, 2, "x"), (2, "nothing", 3, 4, "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, __t1 int, N_HIT int, items string")
    found = mark_contaminated(d, spark.createDataFrame(items, "item_id string, text string"), share=share)
    assert found.columns[:4] == ["doc_id", "text", "__t1", "items"] and "N_HIT" not in found.columns
    rows = {r.doc_id: (r["__t1"], r["items"], r.n_hit, r.n_items, r.items_sha256) for r in found.collect()}
    assert rows[1] == (1, "x", 11, 2, hashlib.sha256(b"q-a,q-b").hexdigest())
    assert rows[2] == (3, "y", 0, 0, hashlib.sha256(b"").hexdigest())


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert mark_contaminated(d, b).first().n_hit == 0
    assert mark_contaminated(d.limit(0), b).count() == 0
