from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gapline.llm.ngram_join import _parity, _Parities, budgets
from gapline.llm.substring_dedup import _sliding_min
from gapline.llm.textkernel import Hasher, equal_words, find_words, pieces

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAé \t\n\x0b\x1c\xa0漢", max_size=30)), max_size=8)


def words(texts, limit):
    out = []
    for lo, hi, data, bounds in pieces(pa.array(texts, pa.string()), limit):
        starts, ends, first = find_words(data, bounds)
        raw = data.tobytes()
        for k in range(hi - lo):
            out.append([raw[starts[i] : ends[i]].decode() for i in range(first[k], first[k + 1])])
    return out


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words(texts, limit):
    assert words(texts, limit) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_words_of_a_slice():
    array = pa.array(["a b", "c", None, "d e f"]).slice(1)
    ((lo, hi, data, bounds),) = pieces(array)
    assert (lo, hi, data.tobytes(), bounds.tolist()) == (0, 3, b"cd e f", [0, 1, 1, 6])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_equal_ranges_have_equal_hashes(values, width):
    x, hasher = np.array(values, np.uint64), Hasher(1)
    grams = hasher.grams(x, width)
    assert len(grams) == max(0, len(x) - width + 1)
    seen = {}
    for i, h in enumerate(grams.tolist()):
        assert seen.setdefault(tuple(values[i : i + width]), h) == h
    assert len(set(seen.values())) == len(seen)
    starts, ends = np.triu_indices(len(x) + 1)
    seen = {}
    for a, b, h in zip(starts, ends, hasher.ranges(x, starts, ends).tolist(), strict=True):
        assert seen.setdefault(tuple(values[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab", min_size=1, max_size=20), st.sampled_from(["x" * 256, "x" * 257, "x" * 300])), min_size=1, max_size=30))
def test_equal_words_have_equal_hashes(found):
    data = np.frombuffer(" ".join(found).encode(), np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    seen = {}
    hashes = Hasher(2).words(data, starts, ends)
    for w, h in zip(found, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for k, w in enumerate(found):
        same = equal_words(data, starts, ends, np.full(len(found), k))
        assert same.tolist() == [x == w for x in found]


def test_words_in_the_order_of_thue_and_morse_differ_from_their_swap():
    order = np.array([bin(k).count("1") % 2 for k in range(4096)], np.uint8)
    data = np.concatenate([97 + order, [32], 98 - order]).astype(np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    for seed in (11, 12, 21, 31, 41):
        hasher = Hasher(seed)
        assert len(set(hasher.words(data, starts, ends).tolist())) == 2
        for n in (64, 200):  # short words, and ranges of words
            words = np.concatenate([97 + order[:n], [32], 98 - order[:n]]).astype(np.uint8)
            s, e, _ = find_words(words, np.array([0, len(words)]))
            assert len(set(hasher.words(words, s, e).tolist())) == 2
        w = order.astype(np.uint64) + np.uint64(5)
        both = np.concatenate([w, np.uint64(11) - w])
        assert len(set(hasher.ranges(both, np.array([0, 4096]), np.array([4096, 8192])).tolist())) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 60))
def test_sliding_minimum(values, width):
    if width <= len(values):
        got = _sliding_min(np.array(values), width).tolist()
        assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=200), st.sets(st.integers(0, (1 << 64) - 1), max_size=60), st.integers(0, 60))
def test_parities_never_exceed_the_difference(a, more, drop):
    b = set(sorted(a)[drop:]) | more
    if b:
        x, y = (_parity(np.array(sorted(s), np.uint64)) for s in (a, b))
        there, back = _Parities([x, y]).distance(np.array([0, 1]), np.array([1, 0]))
        assert there == back <= len(a ^ b)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.data())
def test_budgets_bound_every_linked_pair(n, data):
    m = data.draw(st.integers(max(1, -(-85 * n // 100)), 100 * n // 85))
    both = data.draw(st.integers(0, min(n, m)))
    if 100 * both >= 85 * (n + m - both):
        d, total = budgets(n, 85)
        assert n - both <= d and n + m - 2 * both <= total
