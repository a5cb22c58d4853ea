"""Count-min sketches of ``depth`` rows by ``width`` counters, one for each partition, merged by addition.

A key adds one to a counter in each row.  The least of its counters is its
estimate, which is never below its count.  Sketches travel as segments of
``SEGMENT`` counters, of which only those above zero are named, so a sketch
costs what its partition counted and not its width.  Equal segments are summed
in steps of at most ``FAN`` partial ones, so no task gathers those of a large
corpus.  What reaches the driver is a bit for each counter, set where it has
reached a limit: ``depth * width / 8`` bytes, at most ``depth * WIDE / 8``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.textkernel import U64, mix

#: Counters of a segment, and limits of a row's width.
SEGMENT = 1 << 16
NARROW, WIDE = 1 << 16, 1 << 28
#: Keys counted before they are added up, and distinct counters held before they are handed on.
STEP, HELD = 1 << 18, 1 << 22
FAN = 64
SCHEMA = "segment long, cells binary"
MOST = (1 << 32) - 1


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places in a segment and their counts, byte by byte of the steps and counts, which compress well."""
    steps = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
    counts = np.minimum(n, MOST).astype("<u4").view(np.uint8).reshape(-1, 4)
    return steps.T.tobytes() + counts.T.tobytes()


def unpack(data: pa.BinaryScalar | bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts)"""
    planes = np.frombuffer(data if isinstance(data, bytes) else data.as_buffer(), np.uint8).reshape(6, -1)
    steps = np.ascontiguousarray(planes[:2].T).view("<u2")[:, 0]
    return np.cumsum(steps, dtype=np.int64), np.ascontiguousarray(planes[2:].T).view("<u4")[:, 0]


def width_for(keys: int, load: float) -> int:
    """Counters of a row for so many keys at ``load`` of them to a counter, a power of two."""
    return int(min(max(NARROW, 1 << (max(1, int(keys / load)) - 1).bit_length()), WIDE))


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    """The number of each key's counter in a row, rows counted through."""
    return (mix(keys + U64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) & U64(width - 1)).astype(np.int64) + row * width


class Partial:
    """A partition's sketch while it is made."""

    def __init__(self, depth: int, width: int):
        self.depth, self.width = depth, width
        self.places, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def _sum(self) -> None:
        new = np.concatenate([cells(k, row, self.width) for k in self.waiting for row in range(self.depth)])
        at, n = np.unique(new, return_counts=True)
        here = np.searchsorted(self.places, at)
        known = np.append(self.places, -1)[here] == at
        self.counts[here[known]] += n[known]
        self.places = np.insert(self.places, here[~known], at[~known])
        self.counts = np.insert(self.counts, here[~known], n[~known])
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Count the keys; yields (segments, their counters) when many are held."""
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= STEP:
            self._sum()
            if len(self.places) >= HELD:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """What is held still."""
        if self.size:
            self._sum()
        if len(self.places):
            yield _segments(self.places, self.counts)
            self.places, self.counts = self.places[:0], self.counts[:0]


def _segments(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    segment = places // SEGMENT
    cuts = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(places))
    at = places % SEGMENT
    return segment[cuts[:-1]], [pack(at[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def partial(keys: Iterable[np.ndarray], depth: int, width: int) -> Iterator[pa.RecordBatch]:
    """This partition's sketch, as segments."""
    made = Partial(depth, width)
    for found in chain(chain.from_iterable(map(made.add, keys)), made.rest()):
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1], pa.binary())], names=["segment", "cells"])


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(SEGMENT, np.uint64)
    for x in table.column("cells"):
        at, n = unpack(x)
        total[at] += n  # a place is named once
    at = np.flatnonzero(total)
    return pa.table({"segment": table.column("segment")[:1], "cells": pa.array([pack(at, total[at])], pa.binary())})


def merged(parts: DataFrame, count: int) -> DataFrame:
    """The sum of ``count`` partial sketches or about as many, a row for each segment."""
    salt = max(1, count)
    while True:
        salt = -(-salt // FAN)
        parts = parts.groupBy("segment", F.pmod(F.xxhash64("cells"), F.lit(salt))).applyInArrow(_sum, SCHEMA)
        if salt == 1:
            return parts


def reached(sketch: DataFrame, limit: int, depth: int, width: int) -> np.ndarray:
    """A bit for each counter of at least ``limit``."""

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                at, n = unpack(x)
                bits = np.zeros(SEGMENT, bool)
                bits[at[n >= limit]] = True
                out.append(np.packbits(bits, bitorder="little").tobytes() if bits.any() else None)
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["segment", "cells"])
            yield found.filter(found.column(1).is_valid())

    bits = np.zeros(depth * width // 8, np.uint8)
    for row in sketch.mapInArrow(flags, SCHEMA).toLocalIterator():
        part = bits[row["segment"] * SEGMENT // 8 :][: SEGMENT // 8]
        part[:] = np.frombuffer(row["cells"], np.uint8)[: len(part)]
    return bits


def all_set(keys: np.ndarray, bits: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Whether the estimate of each key has reached the limit: whether all its counters have."""
    out = np.ones(len(keys), bool)
    for row in range(depth):
        at = cells(keys, row, width)
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out
