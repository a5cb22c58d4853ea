"""Vectorised words and hashes over Arrow text.

Words are maximal runs of UTF-8 bytes outside ``[\\x20\\x09-\\x0D]``.  Those are
ASCII characters, so working on bytes gives the same words as working on
characters.  A word's hash takes in eight bytes at a time; a range of words is
hashed by the pieces of a power of two that cover it.  Texts are worked on in
pieces, so memory follows the piece, or the longest text if that is longer.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

from gapline.deploy import ship

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text worked on at once, if no single text is longer.
PIECE = 2 << 20
U64 = np.uint64
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


class Hasher:
    """64-bit hashes of words and of ranges of words.

    Every step ends in a non-linear mixer, so sequences of a regular structure
    (two symbols in the order of Thue and Morse, say) meet no sooner than others.
    """

    def __init__(self, seed: int):
        salts = np.random.default_rng(seed).integers(1, 1 << 63, 4, dtype=U64) * U64(2) + U64(1)
        self.start, self.left, self.pair, self.size = salts
        self.key = self.start.tobytes()

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes ``data[s:e]`` for each word."""
        n = ends - starts
        out = mix(self.start ^ n.astype(U64) * self.size)
        lanes = _lanes(data)
        some, done = np.flatnonzero(n <= LONG_WORD), 0
        while len(some):
            part = lanes[starts[some] + done] & LANE[np.minimum(n[some] - done, 8)]
            out[some] = mix((out[some] ^ part) * self.left)
            done += 8
            some = some[n[some] > done]
        for k in np.flatnonzero(n > LONG_WORD):
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=self.key).digest(), "little")
        return out

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(a * self.left) + b ^ self.pair)

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """A hash of each ``n`` consecutive words."""
        if len(words) < n:
            return words[:0]
        if n == 1:
            return mix(words ^ self.size)
        half = self.grams(words, n // 2)
        both = self._join(half[: len(half) - n // 2], half[n // 2 :])
        return self._join(both[: len(words) - n + 1], words[n - 1 :]) if n % 2 else both

    def ranges(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of ``words[s:e]`` for each range: its length and the two longest pieces of a power of two."""
        n = ends - starts
        out = np.full(len(n), mix(self.size[None] ^ U64(1))[0], U64)
        level, span = mix(words ^ self.size), 1
        while len(some := np.flatnonzero((n >= span) & (n < 2 * span))) or (n >= span).any():
            if len(some):
                ends_of = self._join(level[starts[some]], level[ends[some] - span])
                out[some] = mix(ends_of ^ n[some].astype(U64) * self.size)
            if len(level) <= span:
                break
            level, span = self._join(level[:-span], level[span:]), span * 2
        return out


def equal_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of the word whose number ``other`` gives."""
    n = ends - starts
    same = n == n[other]
    lanes, some, done = _lanes(data), np.flatnonzero(same & (other != np.arange(len(n)))), 0
    while len(some):
        keep = LANE[np.minimum(n[some] - done, 8)]
        same[some] = (lanes[starts[some] + done] & keep) == (lanes[starts[other[some]] + done] & keep)
        done += 8
        some = some[same[some] & (n[some] > done)]
    return same


def pieces(text: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts in the bytes); null counts as empty."""
    pa.set_memory_pool(pa.system_memory_pool())  # which returns large blocks when they are freed
    text = text.fill_null("") if text.null_count else text
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(offsets, kind)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more at the end)."""
    space = WHITESPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    after = np.empty(len(data), bool)
    after[:1] = True
    after[1:] = space[:-1]
    before = np.empty(len(data), bool)
    before[-1:] = True
    before[:-1] = space[1:]
    starts = np.flatnonzero(~space & (after | edge[:-1]))
    ends = np.flatnonzero(~space & (before | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def tidy(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The generator, with the memory that its task has freed given back to the system at its end.

    Spark keeps a worker for later tasks and later stages, beside others and the JVM.
    """

    @wraps(function)
    def inner(*args, **kwargs):
        try:
            yield from function(*args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return inner


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bound_arrow_batches(spark, mb: int = 4) -> None:
    """Send the package to the workers and keep batches that go to Python small, whatever the length of the texts."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key, "0").rstrip("b") or 0) in (0, 2**31 - 1, 64 << 20, 256 << 20):
            spark.conf.set(key, str(mb << 20))
    except Exception:  # an older Spark without the setting
        pass
