"""The pipeline on a small corpus, each stage against a brute-force version of its decision."""

from __future__ import annotations

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from gapline.llm import queries, toxicity  # noqa: E402
from gapline.llm.packing import Encoder  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [a + b for a in ("ta", "ri", "mo", "ne", "su", "ko") for b in ("na", "le", "vo", "pi", "da", "")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(25)) for k in range(5)]
    texts = []
    for k in range(240):
        body = text(rng.randint(30, 90))
        if k % 8 == 0:
            words = body.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "crudeword"]))
            body = " ".join(words)
        texts.append(body)
    texts += [" ".join(t.split(" ")[:20]) + "\n " + " ".join(t.split(" ")[20:]) for t in texts[1:20]]  # equal but for blanks
    texts += [t + " tail" for t in texts[21:40]]  # near copies
    texts += [f"{text(20)} {items[k % 5][1]} {text(20)}" for k in range(10)]  # leaks
    texts += ["", None, "short"]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 1, int("word" in t)) for k, t in enumerate(texts[:240])]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def brute(name, docs, items):
    words = {i: (t or "").lower().split() for i, t in docs.items()}
    if name == "toxicity":
        return {i for i in docs if not any(w in ("vileword", "crudeword") for w in words[i])}
    if name == "exact_dedup":
        best = {}
        for i, t in docs.items():
            k = re.sub(r"\s", "", t or "")
            best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
        return {i for _, i in best.values()}
    if name == "ngram_join":
        sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for i, w in words.items()}
        gone, order = {}, sorted(docs)
        root = lambda x: x if gone.get(x, x) == x else root(gone[x])
        for a in order:
            for b in order:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    gone[y] = x
        return {i for i in order if root(i) == i}
    windows = {tuple(w[k : k + 10]) for t in items for w in [t.split()] for k in range(len(w) - 9)}
    return {i for i, w in words.items() if not any(tuple(w[k : k + 10]) in windows for k in range(len(w)))}


def test_stages(spark, corpus):
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        rows = stage(spark, docs, corpus)
        assert rows.columns == docs.columns
        kept = rows.collect()
        assert {r.doc_id for r in kept} == brute(name, before, items), name
        assert len(kept) < len(before) and all(before[r.doc_id] == r.text for r in kept)
        docs = spark.createDataFrame(kept, COLUMNS)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    coder = Encoder(open(queries.tokenizer_path(), encoding="utf-8").read())
    import pyarrow as pa

    kept = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.doc_id, r.length) for r in packed) == [(i, len(x)) for (i, _), x in zip(kept, coder.encode(pa.array([t for _, t in kept], pa.string())), strict=True)]
    run = corpus_pipeline.run(spark, corpus).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in run) == sorted((r.doc_id, r.ids_crc32) for r in packed)


def test_nothing_held_out_is_learned(spark, corpus):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    import zlib

    held = {r.doc_id for r in labels.filter(queries.held_out()).collect()}
    assert held == {k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1}
    lexicon = queries.toxicity_lexicon(spark, corpus)
    assert toxicity.Scorer(lexicon).score("a vileword and a crudeword here") >= toxicity.THRESHOLD


def test_near_copies_by_five_words_and_four_fifths(spark, tmp_path):
    """Pairs that link by five words and 0.8, and not by four words and 0.85, and one that does not by either."""
    word = lambda k: f"w{k}"
    long = [word(k) for k in range(1000, 1200)]
    changed = [f"x{k}" if k in (20, 60, 100, 140) else w for k, w in enumerate(long)]
    far = [f"y{k}" if k % 20 == 10 else word(2000 + k) for k in range(200)]
    texts = [
        [word(k) for k in range(100)],
        [word(k) for k in range(118)],  # 96 of 114
        long,
        changed,  # 176 of 216
        [word(2000 + k) for k in range(200)],
        far,  # 146 of 246
    ]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", len(" ".join(t))) for k, t in enumerate(texts)], COLUMNS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 4, 5]
