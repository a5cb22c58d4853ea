from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gapline.llm import packing
from gapline.llm.packing import Encoder, best_fit, pack_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(2)
    letters = "abcXYZ'sétßıİŐΣσς́̇.,;:!?-–…0١19 \n\t\x0b\x1c\x85\xa0 漢字<|endoftext|>µªº×÷ǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", "<|endoftext|> it's we'LL Don't", "Word. word, WORD! wörd", "a" * 5000, "İ. Éa.", "ÀÞßÿ, Ã× Ã÷. Ã", "×", "a× ÷b.", "WORD", "word", "Word?!"]
    coder, right = Encoder(open(PATH, encoding="utf-8").read()), reference()
    for _ in range(2):
        got = coder.encode(pa.array([*texts, None]))
        assert [x.tolist() for x in got] == [right(t) for t in [*texts, ""]]


def test_a_tokenizer_that_keeps_blanks_sees_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    right = Tokenizer.from_file(path)
    texts = ["a b", " The cat\n", "", "é  x"]
    got = Encoder(open(path, encoding="utf-8").read()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [[*right.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def variants():
    """The bundled tokenizers, and word tokenizers that tell upper from lower case or keep accents apart."""
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        yield open(public_tokenizers.path(name), encoding="utf-8").read()
    parts = json.loads(Tokenizer.from_file(PATH).to_str())
    steps = parts["normalizer"]["normalizers"] if parts["normalizer"]["type"] == "Sequence" else [parts["normalizer"]]
    for k, step in enumerate(steps):
        yield json.dumps(parts | {"normalizer": {"type": "Sequence", "normalizers": [s for j, s in enumerate(steps) if j != k]}}), step["type"]


@pytest.mark.parametrize("vocabulary", [v if isinstance(v, str) else v[0] for v in variants()], ids=lambda v: str(len(v)))
def test_encoder_tries_the_tokenizer_out(vocabulary):
    from tokenizers import Tokenizer

    right = Tokenizer.from_str(vocabulary)
    right.encode_special_tokens = True
    texts = ["HELLO World again", "Hello, WORLD. world", " a  b\tC\nÉté ÉTÉ été", "THE the The. tHe!", "x\x0by\x0cz\r\n", ""]
    got = Encoder(vocabulary).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [[*right.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_with_equal_hashes_keep_their_own_ids(monkeypatch):
    """Words in the order of Thue and Morse, and a hash that tells no words apart."""
    order = [bin(k).count("1") % 2 for k in range(2048)]
    texts = ["".join("ab"[x] for x in order), "".join("ba"[x] for x in order), "Aa bb. 12 bb aA 21 é"]
    right = reference()
    assert [x.tolist() for x in Encoder(open(PATH, encoding="utf-8").read()).encode(pa.array(texts))] == [right(t) for t in texts]
    monkeypatch.setattr(packing.Hasher, "words", lambda self, data, starts, ends: np.zeros(len(starts), np.uint64))
    assert [x.tolist() for x in Encoder(open(PATH, encoding="utf-8").read()).encode(pa.array(texts))] == [right(t) for t in texts]


def plain_best_fit(lengths, limits, rule):
    """The rule by loops over lists."""
    bins, out = [], [None] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = (float(lengths[at]), 1.0, float(lengths[at]) ** 2)
        best = None
        for k, left in enumerate(bins):
            if all(r >= n for r, n in zip(left, need, strict=True)):
                if rule == "norm":
                    score = sum(w * ((r - n) / c) ** 2 for w, r, n, c in zip(packing.WEIGHTS, left, need, limits, strict=True))
                else:
                    score = -sum(w * n / c**2 * r for w, r, n, c in zip(packing.WEIGHTS, left, need, limits, strict=True))
                best = min(best or (round(score, 9), k), (round(score, 9), k))
        k = best[1] if best else len(bins)
        if not best:
            bins.append([float(c) for c in limits])
        out[at] = (k, int(limits[0] - bins[k][0]))
        bins[k] = [r - n for r, n in zip(bins[k], need, strict=True)]
    return len(bins), out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 3_000), (100, 4, 4_500)])
def test_limits_that_bind_against_brute_force(rule, limits):
    rng = np.random.default_rng(5)
    for _ in range(15):
        lengths = rng.integers(1, 55, int(rng.integers(1, 90)))
        bins, offsets = best_fit(lengths, limits, rule)
        count, plain = plain_best_fit(lengths.tolist(), limits, rule)
        assert len(set(bins.tolist())) == count
        for b in set(bins.tolist()):
            own = lengths[bins == b]
            assert own.sum() <= limits[0] and len(own) <= limits[1] and (own**2).sum() <= limits[2]
        # ties may fall on other sequences, so sizes are compared and not their numbers
        fill = lambda found: sorted(sum(int(lengths[i]) for i, k in enumerate(found) if k == b) for b in set(found))
        assert fill(bins.tolist()) == fill([k for k, _ in plain])


def placed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_pieces_and_places(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Word.", "zyx"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (301, ""), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = pack_documents(df, PATH, capacity=16).collect()
    right, want = reference(), []
    for i, t in rows:
        ids = right(t or "")
        for k in range(0, len(ids), 16):
            part = ids[k : k + 16]
            want.append((i, k // 16, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = placed(got, 16)
    assert len(bins) <= -(-sum(x[3] for x in want) // 16) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    bins, offsets = best_fit(lengths, (100, 5, 6000 + 99 * 99), rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 5 and (own**2).sum() <= 6000 + 99 * 99
    bins, _ = best_fit(lengths, (100, 100, 10_000), rule)
    assert len(np.unique(bins)) <= 1.03 * lengths.sum() / 100 + 1
    with pytest.raises(ValueError):
        best_fit(np.array([50]), (100, 5, 100))


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, PATH).count() == 0
    df = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, length int, group int")
    assert [tuple(r)[:4] for r in pack_documents(df, PATH).collect()] == [(1, 0, 0, 3)]
