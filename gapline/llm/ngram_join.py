"""Jaccard self-join of documents on word n-grams, by token-combination prefixes.

A document's set holds the hashes of its distinct ``shingle``-word sequences,
A-Z lower-cased; with fewer words the whole sequence is its one element, and
without words the set is empty and linked with nothing.  Two documents link when
``100 * intersection >= percent * union``.

Equal sets are collapsed first; what follows works on distinct sets.

*Token classes.*  A count-min sketch of all elements, summed over partitions,
tells rare, frequent and very frequent elements apart (any class function keeps
the join exact).  Elements are ordered by class, then by hash.  Rare ones are
indexed singly, frequent ones in pairs, very frequent ones in triples, so the
more frequent a token, the more tokens its index key combines.

*Prefixes.*  A set of n elements shares at least ceil(t n) with a partner, so at
most d = n - ceil(t n) of its elements are unshared; D bounds the unshared ones of
both sets together.  U, V are the numbers of its rare and frequent elements.

- The first shared element is among the set's first d + 1.  If it is rare, both
  sets index it: k = 1 over the rare elements of this prefix.
- Otherwise all rare elements are unshared, so U <= d.  Each unshared element can
  stand between two shared frequent ones only once, so of D - U + 2 shared ones two
  are neighbours in both sets: k = 2 over the neighbours among the first
  (d - U) + (D - U) + 2 frequent elements.
- If fewer are shared, V <= (d - U) + (D - U) + 1.  Each unshared element can break
  two triples of very frequent ones, so of 2 (D - U) + 3 shared ones three are
  consecutive in both sets: k = 3 over the first (d - U) + 2 (D - U) + 3.

A pair of s shared and D unshared elements has such a triple if s >= 2 D + 4.
Only small sets can lack it (``small``: of up to 6 elements at t = 0.8, none at
0.85); they index pairs of very frequent elements too.  ``percent`` must be at
least 67.

*Candidates.*  In every index list each set meets the list's representative, the
set with the fewest rare elements; the pairs are verified on the texts and linked
into components.  Lists that hold sets of different components are then compared
block by block, between components only; long lists are split by size first, since
only sets of nearly equal size can link.  Bounds on sizes, on rare elements that
cannot be shared and on the sets' parities reject pairs before they leave a task.
A pair within one component changes no component, so all components are found.

*Links.*  All pairs of different sets within a component are then judged exactly,
in blocks that multiply the sets' incidence matrices and hand on sums, no pairs.  A
row's links count every other row that it links with, copies included.

Null text counts as empty.  A null id is larger than all others and its row's
component is null unless a row with an id is linked.  Repeated rows are linked.
Sets are told apart by 64 bits, and where those meet by 64 others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm import sketch
from gapline.llm.rows import fresh
from gapline.llm.store import Scratch
from gapline.llm.textkernel import FOLD, U64, Hasher, bound_arrow_batches, find_words, mix, pieces, signed, tidy

#: Mean number of elements in a counter of the sketch.
LOAD = 64
#: Elements in a counter from which they are frequent: this, and so many times the mean; very frequent from so many times more.
FREQUENT, TIMES, MORE = 64, 4, 64
#: Cells in a row of a filter of signatures.
SEGMENT = 1 << 14
#: Members of a block in the comparison of lists.
SIDE = 1024
#: Sets and elements of a block in the count of links.
LINK_SIDE, LINK_ELEMENTS = 4096, 1 << 21
#: Partners that one copy of a text is compared with.
VERIFY = 256
#: Most bits of a set's parity.
PARITY = 4096
#: Bits of the filter of signatures that sets share: 16 for each, within limits.
NARROW, FILTER_BITS, FILTER_WIDE = 1 << 16, 16, 1 << 28
KEY = ["nil", "doc", "t1", "t2"]


@cache
def _hasher() -> Hasher:
    return Hasher(21)


def _piece_sets(batch_text: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ascending distinct element hashes of each text, end to end, their bounds) of every piece."""
    hasher = _hasher()
    for lo, _, data, bounds in pieces(batch_text):
        starts, ends, first = find_words(data, bounds)
        words = hasher.words(FOLD[data], starts, ends)
        grams = hasher.grams(words, shingle)
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < shingle))
        count = np.where(size >= shingle, size - shingle + 1, size > 0)
        at = np.append(0, np.cumsum(count))
        found = np.empty(at[-1], U64)
        found[at[short]] = hasher.ranges(words, first[short], first[short + 1])
        for k in np.flatnonzero(size >= shingle):
            part = found[at[k] : at[k + 1]]
            part[:] = grams[first[k] : first[k] + count[k]]
            part.sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[at[:-1][count > 0]] = True
        yield lo, found[new], np.append(0, np.cumsum(new))[at]


def _sets(batch_text: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct element hashes) of each text."""
    for lo, elements, bounds in _piece_sets(batch_text, shingle):
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), lo):
            yield k, elements[a:b]


def _set_ids(elements: np.ndarray, bounds: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Two numbers for each set, the same for equal sets, the first of ``bits`` bits."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    sums = np.zeros((2, len(n)), U64)
    if len(some):
        for row, salted in enumerate((elements ^ U64(0x9E3779B97F4A7C15), elements + U64(0x2545F4914F6CDD1D))):
            sums[row, some] = np.add.reduceat(mix(salted), bounds[some])
        sums[:, some] = mix(sums[:, some] + n[some].astype(U64) * U64(0x9FB21C651E98DF25))
    return list(zip(signed(sums[0] >> U64(64 - bits)).tolist(), signed(sums[1]).tolist(), strict=True))


Names = dict[tuple[int, int], int]


def _named_sets(batch_text: pa.Array, shingle: int, bits: int) -> Iterator[tuple[int, tuple[int, int], np.ndarray]]:
    """(row, the set's two numbers, ascending distinct element hashes) of each text."""
    for lo, elements, bounds in _piece_sets(batch_text, shingle):
        ids = _set_ids(elements, bounds, bits)
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield lo + k, ids[k], elements[a:b]


def _parity(elements: np.ndarray) -> bytes:
    """A bit array in which each element flips one bit; as many bits as elements, up to a power of two."""
    size = min(max(64, 1 << len(elements).bit_length()), PARITY)
    odd = np.bincount((elements >> U64(40)).astype(np.int64) & size - 1, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@tidy
def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose parities do not rule a link out.  Columns: a, b, n and parity of either."""
    for batch in batches:
        size = batch.num_rows
        n = (batch.column(2).to_numpy() + batch.column(4).to_numpy()) * (100 - percent) // (100 + percent)
        parities = _Parities(batch.column(3).to_pylist() + batch.column(5).to_pylist())
        keep = pa.array(parities.distance(np.arange(size), size + np.arange(size)) <= n)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


DESCRIBED = "nil int, doc long, t1 long, t2 long, raw long, check long, n long, parity binary, segment long, cells binary"


@tidy
def _describe(batches: Iterator[pa.RecordBatch], shingle: int, id_bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """A row for each text, and then this partition's sketch of the elements; copies that meet here count once."""
    names = [x.split()[0] for x in DESCRIBED.split(", ")]
    counts, seen = sketch.Partial(1, width), set()

    def segments(found: tuple[np.ndarray, list[bytes]]) -> pa.RecordBatch:
        size = len(found[1])
        none = [pa.nulls(size, pa.int32()), *[pa.nulls(size, pa.int64())] * 6, pa.nulls(size, pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(found[0]), pa.array(found[1], pa.binary())], names=names)

    for batch in batches:
        out = []
        for _, sid, s in _named_sets(batch.column(4), shingle, id_bits):
            out.append((*sid, len(s), _parity(s)))
            if len(s) and sid not in seen:
                seen.add(sid)
                yield from map(segments, counts.add(s.copy()))  # a part would hold the whole piece
        made = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        none = [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made, *none], names=names)
    yield from map(segments, counts.rest())


class Classes:
    """Bits of the counters that hold frequent and very frequent elements."""

    def __init__(self, bits: tuple[np.ndarray, np.ndarray], width: int):
        self.bits, self.width = bits, width

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rare, frequent, very frequent) elements."""
        at = sketch.cells(s, 0, self.width)
        often, hot = ((b[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for b in self.bits)
        return s[~often], s[often & ~hot], s[hot]


def token_classes(segments: DataFrame, count: int, width: int, elements: int, scratch: Scratch) -> Classes:
    """The classes by ``count`` partial sketches of ``elements`` elements; their bits take at most ``2 * sketch.WIDE / 8`` bytes."""
    counts = scratch.keep(sketch.merged(segments, count), "counts")
    limit = max(FREQUENT, TIMES * elements // width)
    bits = tuple(sketch.reached(counts, k, 1, width) for k in (limit, limit * MORE))
    scratch.drop("counts")
    return Classes(bits, width)


@tidy
def _mark(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """This partition's signatures as bits, in segments."""
    bits = np.zeros(width, bool)
    for batch in batches:
        bits[(batch.column(0).to_numpy().view(U64) & U64(width - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little")
    for k in range(0, len(packed), SEGMENT):
        part = packed[k : k + SEGMENT]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // SEGMENT], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "cells"]
            )


def _either(table: pa.Table) -> pa.Table:
    out = np.zeros(SEGMENT, np.uint8)
    for x in table.column("cells"):
        part = np.frombuffer(x.as_buffer(), np.uint8)
        out[: len(part)] |= part
    return pa.table({"segment": table.column("segment")[:1], "cells": pa.array([out.tobytes()], pa.binary())})


def shared_filter(signatures: DataFrame, count: int) -> np.ndarray:
    """Bits that are set for every signature; a wrongly set one only lets a useless row through."""
    width = int(min(max(NARROW, 1 << (FILTER_BITS * max(1, count)).bit_length()), FILTER_WIDE))
    schema = "segment int, cells binary"
    parts = signatures.mapInArrow(lambda it: _mark(it, width), schema)
    for salt in (8, 1):
        parts = parts.groupBy("segment", F.pmod(F.xxhash64("cells"), F.lit(salt))).applyInArrow(_either, schema)
    bits = np.zeros(width // 8, np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["cells"], np.uint8)[: width // 8]
        bits[row["segment"] * SEGMENT :][: len(part)] = part
    return bits


def budgets(n: int, percent: int) -> tuple[int, int]:
    """(d, D): unshared elements of a set of n, and of it and its largest partner together."""
    return n - -(-percent * n // 100), (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def small(percent: int) -> int:
    """The size up to which linked sets may have no three consecutive shared elements."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    found, apart = 0, 1
    while percent < 100 and -(-percent * apart // (100 - percent)) <= 2 * apart + 3:
        found, apart = 3 * apart + 3, apart + 1
    return found


def combinations(s: np.ndarray, classes: Classes, percent: int) -> tuple[list[tuple[np.ndarray, int]], int]:
    """((signatures, k - 1) of a set, the number of its rare elements)."""
    n = len(s)
    d, both = budgets(n, percent)
    rare, often, hot = classes.split(s)
    out = [(mix(rare[: d + 1]), 0)]
    u = len(rare)
    if u <= min(d, both):
        room = d + both - 2 * u + 2
        top = (np.concatenate([often, hot]) if n <= small(percent) else often)[:room]
        out.append((mix(mix(top[:-1]) * U64(3) + top[1:]), 1))
        if len(often) < room:
            top = hot[: room + both - u + 1]
            out.append((mix(mix(mix(top[:-2]) * U64(3) + top[1:-1]) * U64(5) + top[2:]), 2))
    return [x for x in out if len(x[0])], u


@tidy
def _signatures(
    batches: Iterator[pa.RecordBatch], shingle: int, percent: int, id_bits: int, classes: Classes, renamed: Names, wanted: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """(sig, sid, info) of the sets; ``info`` packs size, number of rare elements and whether sig is a combination.

    With ``wanted``, the bits of signatures that sets share, others are left out, and a
    row (null, sid, null, text) goes before those of a set.
    """
    seen: set[int] = set()
    names = ["sig", "sid", "info"] + ["text"] * (wanted is not None)

    def rows(signs: list[np.ndarray], sids: list[int], infos: list[int]) -> pa.RecordBatch:
        counts = [len(x) for x in signs]
        columns = [np.concatenate(signs).view(np.int64), np.repeat(np.array(sids, np.int64), counts), np.repeat(np.array(infos, np.int64), counts)]
        made = [pa.array(c) for c in columns] + [pa.nulls(sum(counts), pa.string())] * (wanted is not None)
        return pa.RecordBatch.from_arrays(made, names=names)

    for batch in batches:
        signs, sids, infos, held, texts, owners = [], [], [], 0, [], []
        for i, ids, s in _named_sets(batch.column(0), shingle, id_bits):
            n = len(s)
            sid = renamed.get(ids, ids[0])  # or another one if a different set has that too
            if not budgets(n, percent)[1] or sid in seen:  # a set with no room for a different partner, or one done already
                continue
            seen.add(sid)
            made, rare = combinations(s, classes, percent)
            before = len(signs)
            for out, k in made:
                if wanted is not None:
                    at = out & U64(len(wanted) * 8 - 1)
                    out = out[(wanted[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1]
                if len(out):
                    signs.append(out), sids.append(sid), infos.append(n << 32 | rare << 1 | (k > 0))
                    held += len(out)
            if wanted is not None and len(signs) > before:
                texts.append(i), owners.append(sid)
            if held > 200_000:
                yield rows(signs, sids, infos)
                signs, sids, infos, held = [], [], [], 0
        if texts:
            none = pa.nulls(len(texts), pa.int64())
            own = batch.column(0).take(pa.array(texts, pa.int64()))
            yield pa.RecordBatch.from_arrays([none, pa.array(owners, pa.int64()), none, own], names=names)
        if signs:
            yield rows(signs, sids, infos)


class _Parities:
    """Parities of a block's sets, as one matrix for each length."""

    def __init__(self, parities: list[bytes]):
        self.size = np.array([len(p) // 8 for p in parities], np.int64)
        self.place, self.rows = np.empty(len(parities), np.int64), {}
        for size in np.unique(self.size):
            own = np.flatnonzero(self.size == size)
            self.place[own] = np.arange(len(own))
            self.rows[size] = np.frombuffer(b"".join(parities[k] for k in own), U64).reshape(-1, size)

    def _folded(self, k: np.ndarray, size: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.rows[size][self.place[k]].reshape(len(k), -1, to), axis=1)

    def distance(self, x: np.ndarray, y: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """At most the symmetric differences of the sets x and y."""
        out = np.empty(len(x), np.int64)
        for lo in range(0, len(x), step):
            a, b = x[lo : lo + step], y[lo : lo + step]
            for p in np.unique(self.size[a]):
                for q in np.unique(self.size[b]):
                    k = np.flatnonzero((self.size[a] == p) & (self.size[b] == q))
                    if len(k):
                        to = min(p, q)
                        bits = np.bitwise_count(self._folded(a[k], p, to) ^ self._folded(b[k], q, to))
                        out[lo + k] = bits.sum(axis=1, dtype=np.int64)
        return out


def _across(columns: dict[str, np.ndarray], parities: list[bytes], same: bool, pair: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs worth verifying between two blocks of one index list, or within one block."""
    sid, n, rare, comp = (columns[k] for k in ("sid", "n", "rare", "comp"))
    left, right = (np.arange(len(sid)),) * 2 if same else (np.flatnonzero(columns["side"] == k) for k in (0, 1))
    nx, ny = n[left][:, None], n[right][None, :]
    ok = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
    if pair:
        ok &= (rare[left][:, None] + rare[right][None, :]) * (100 + percent) <= (nx + ny) * (100 - percent)
    if same:
        ok &= sid[left][:, None] < sid[right][None, :]
    a, b = np.nonzero(ok)
    x, y = left[a], right[b]
    if len(x):
        near = _Parities(parities).distance(x, y) <= (n[x] + n[y]) * (100 - percent) // (100 + percent)
        x, y = x[near], y[near]
    return sid[x], sid[y]


@tidy
def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of every block."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        column = {k: table.column(k).to_numpy() for k in table.column_names if k != "parity"}
        parities = table.column("parity").to_pylist()
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in _cuts(column):
            part = {k: column[k][a:b].astype(np.int64) for k in ("sid", "n", "rare", "comp", "side")}
            x, y = _across(part, parities[a:b], _within(column, a), bool(column["pair"][a]), percent)
            xs.append(x), ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return _by_block(batches, pairs)


def _incidence(part: np.ndarray, rows: int, lo: int, hi: int, row: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, hi - lo), np.float32)
    here = (part >= lo) & (part < hi)
    out[row[here], part[here] - lo] = 1
    return out


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 1 << 23) -> np.ndarray:
    """The number of elements that each set of ``left`` shares with each of ``right``."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1  # others are in one set only
    keep = often[number]
    number, own = (np.cumsum(often) - 1)[number[keep]], own[keep]
    total, columns = int(often.sum()), max(1, step // max(1, len(sets)))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, total, columns):
        made = _incidence(number, len(sets), lo, min(lo + columns, total), own)
        out += made[left] @ made[right].T
    return out


@tidy
def _link_counts(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(sid, number of rows with other sets that it links with) of every block."""

    def counts(table: pa.Table) -> pa.RecordBatch:
        column = {k: table.column(k).to_numpy() for k in table.column_names if k != "text"}
        sets = [s for _, s in _sets(table.column("text").chunk(0), shingle)]
        sids, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in _cuts(column):
            n, copies, sid = (column[k][a:b].astype(np.int64) for k in ("n", "copies", "sid"))
            same = _within(column, a)
            sides = (np.arange(b - a),) * 2 if same else [np.flatnonzero(column["side"][a:b] == k) for k in (0, 1)]
            both = shared_counts(sets[a:b], *sides)
            # whole numbers below 2**24, which 32-bit floating numbers hold exactly
            back = np.zeros(len(sides[1]), np.int64)
            for lo in range(0, len(both), 256):
                x = sides[0][lo : lo + 256]
                inner = both[lo : lo + 256].astype(np.int64)
                linked = 100 * inner >= percent * (n[x][:, None] + n[sides[1]][None, :] - inner)
                if same:
                    linked &= x[:, None] != sides[1][None, :]
                sids.append(sid[x])
                sums.append(linked @ copies[sides[1]])
                back += copies[x] @ linked
            if not same:
                sids.append(sid[sides[1]])
                sums.append(back)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sids)), pa.array(np.concatenate(sums))], names=["sid", "links"])

    return _by_block(batches, counts)


BLOCK = ("group", "band", "i", "j")


def _cuts(column: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """The blocks' ranges of rows."""
    new = np.zeros(len(column["i"]), bool)
    new[:1] = True
    for k in BLOCK:
        new[1:] |= column[k][1:] != column[k][:-1]
    cuts = np.append(np.flatnonzero(new), len(new)).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _within(column: dict[str, np.ndarray], at: int) -> bool:
    """Whether the block is compared with itself."""
    return bool(column["i"][at] == column["j"][at] and column["band"][at] % 2 == 0)


def _by_block(batches: Iterator[pa.RecordBatch], function: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``function`` of whole blocks of rows that are sorted by them; a block may go over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held[-1:], batch])
        key = [table.column(k).to_numpy() for k in BLOCK]
        last = np.logical_and.reduce([k == k[-1] for k in key])
        before = len(table) - batch.num_rows  # rows of the batch held last, all of one block
        if last[0] and (not before or last[:before].all()):
            held.append(batch)  # the block goes on
            continue
        cut = int(np.flatnonzero(~last)[-1]) + 1 - before
        yield function(pa.Table.from_batches([*held, batch.slice(0, max(cut, 0))]).combine_chunks())
        held = [batch.slice(max(cut, 0))]
    if held:
        yield function(pa.Table.from_batches(held).combine_chunks())


def band_of(n: Column, percent: int) -> Column:
    """Bands of sizes: sets that link are in the same or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def spread(rows: DataFrame, key: str, whole: Column, sides: Column, percent: int) -> DataFrame:
    """A row of ``rows`` for every block that its set takes part in.

    ``whole`` says, as an aggregate of a group of equal ``key``, that the group is one
    block, ``sides`` into how many shares a band of the group is dealt.  Each share
    meets itself, the others of its band and those of the neighbouring bands.
    """
    banded = rows.withColumn("size", band_of(F.col("n"), percent))
    shares = banded.groupBy(key, "size").agg(sides.cast("int").alias("sides"))
    shares = shares.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("size", "sides"))).alias("sides"))
    shares = rows.groupBy(key).agg(whole.alias("whole")).join(shares, key)
    alone = F.map_from_arrays(F.array(F.lit(0)), F.array(F.lit(1)))
    shares = shares.select(key, "whole", F.when(F.col("whole"), alone).otherwise(F.col("sides")).alias("sides"))
    part = banded.join(shares, key).withColumn("size", F.when(F.col("whole"), 0).otherwise(F.col("size")))
    count = lambda step: F.coalesce(F.try_element_at("sides", F.col("size") + step), F.lit(0))
    part = part.withColumn("own", F.pmod(F.xxhash64("sid"), count(0)).cast("int"))

    def meet(step: int, block: Callable[[Column], Column]) -> Column:
        return F.transform(F.when(count(step) > 0, F.sequence(F.lit(0), count(step) - 1)).otherwise(F.array().cast("array<int>")), block)

    def place(band: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(band.cast("int").alias("band"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    size, own = F.col("size"), F.col("own")
    blocks = F.concat(
        meet(0, lambda q: place(size * 2, F.least(own, q), F.greatest(own, q), own > q)),
        meet(1, lambda q: place(size * 2 + 1, own, q, F.lit(0))),
        meet(-1, lambda q: place(size * 2 - 1, q, own, F.lit(1))),
    )
    made = part.withColumn("block", F.explode(blocks)).withColumnRenamed(key, "group")
    return made.select("group", "block.band", "block.i", "block.j", "block.side", *[c for c in rows.columns if c != key])


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


@tidy
def _verify(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that link.  Columns: a, share, b, text; sorted, with the text of a before those of its partners, b null."""
    own = np.empty(0, np.uint64)
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        first = b.is_null().to_numpy(zero_copy_only=False)
        keep = []
        for i, s in _sets(batch.column(3), shingle):
            if first[i]:
                own = s
                continue
            shared = len(np.intersect1d(own, s, assume_unique=True))
            if 100 * shared >= percent * (len(own) + len(s) - shared):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a).take(at), b.take(at)], names=["a", "b"])


def components(edges: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sid, label) for every sid in ``edges``: the least label within reach.

    ``labels`` has a struct column ``label`` whose last field ``sid`` names the node it
    comes from.  Each round takes the least label of the neighbours, then the label
    of the labelled node, until nothing changes.
    """
    both = scratch.keep(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    nodes = both.select(F.col("a").alias("sid")).distinct().join(labels, "sid")
    state, step = scratch.keep(nodes, f"{name}-0"), 0
    while True:
        step += 1
        near = both.join(state.withColumnRenamed("sid", "b"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("label").alias("near"))
        moved = state.join(near, "sid").select("sid", "label", F.least("label", "near").alias("next"))
        moved = scratch.keep(moved, f"{name}-{step}-near")
        target = moved.select(F.col("sid").alias("to"), F.col("next").alias("far"))
        jumped = moved.join(target, moved["next.sid"] == target["to"]).select("sid", "label", F.least("next", "far").alias("next"))
        jumped = scratch.keep(jumped, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-near")
        changed = jumped.filter(F.col("next") != F.col("label")).limit(1).count()
        state = jumped.select("sid", F.col("next").alias("label"))
        if not changed:
            scratch.drop(f"{name}-edges")
            return state


def names_of(rows: DataFrame, sets: DataFrame) -> Names:
    """New ids of sets that share theirs with a different one.

    Of n sets some n**2 / 2**65 do, a few tens at 10**10.
    """
    met = rows.join(sets.filter("least <> most").select("sid"), "sid", "left_semi").select("raw", "check", "sid").distinct()
    found = met.collect()
    new = signed(mix(np.array([r["sid"] ^ r["check"] for r in found], np.int64).view(U64))).tolist()
    return {(r["raw"], r["check"]): x for r, x in zip(found, new, strict=True)}


def _size_ok(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, links: bool = False, id_bits: int = 64
) -> DataFrame:
    """A row for each row of ``df``: id_col, n_shingles, component_id, first, t1, t2, and n_links if ``links``.

    ``first`` marks the rows of the component's smallest key (id, t1, t2); t1 and t2
    are hashes of the text.  Shorter set ids (``id_bits``) meet more often and change
    no result.
    """
    small(percent)  # or an error
    spark = df.sparkSession
    bound_arrow_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = df.select(*[c.alias(k) for k, c in zip(KEY, _key(id_col, text_col), strict=True)], F.col(text_col).alias("text"))
    # a word takes some six bytes; the width may be off by any factor
    width = sketch.width_for((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6, LOAD)
    described = scratch.keep(docs.mapInArrow(lambda it: _describe(it, shingle, id_bits, width), DESCRIBED), "rows")
    rows = described.filter("segment is null").drop("segment", "cells")
    segments = described.filter("segment is not null").select("segment", "cells")

    def grouped(rows: DataFrame, name: str) -> DataFrame:
        best = F.min(F.struct(*KEY, "parity")).alias("best")
        made = rows.filter("n > 0").groupBy("sid").agg(
            best, F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("least"), F.max("check").alias("most")
        )
        return scratch.keep(made.select("sid", *[f"best.{k}" for k in KEY], "best.parity", "n", "copies", "least", "most"), name)

    raw, renamed = rows, {}
    rows = raw.withColumn("sid", F.col("raw"))
    sets = grouped(rows, "sets")
    while new := names_of(rows, sets):
        renamed |= new
        given = F.broadcast(spark.createDataFrame([(*k, x) for k, x in renamed.items()], "raw long, check long, name long"))
        rows = raw.join(given, ["raw", "check"], "left").withColumn("sid", F.coalesce("name", "raw")).drop("name")
        rows = scratch.keep(rows, f"rows-{len(renamed)}")
        sets = grouped(rows, f"sets-{len(renamed)}")
    elements = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = token_classes(segments, described.rdd.getNumPartitions(), width, elements, scratch)
    shared = spark.sparkContext.broadcast((classes, renamed))
    index = lambda wanted, more="": docs.select("text").mapInArrow(
        lambda it: _signatures(it, shingle, percent, id_bits, *shared.value, wanted and wanted.value), f"sig long, sid long, info long{more}"
    )
    lists = scratch.keep(
        index(None).groupBy("sig").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("sig"), "lists"
    )
    wanted = spark.sparkContext.broadcast(shared_filter(lists, lists.count()))
    scratch.free()
    found = scratch.keep(index(wanted, ", text string"), "index")
    texts = found.filter("text is not null").select("sid", "text").dropDuplicates(["sid"])
    texts = scratch.keep(texts, "texts")
    members = found.filter("text is null").join(lists, "sig", "left_semi").select(
        "sig",
        "sid",
        F.shiftright("info", 32).cast("int").alias("n"),
        F.shiftright(F.col("info").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int").alias("rare"),
        (F.col("info") % 2 == 1).alias("pair"),
    )
    members = scratch.keep(members, "members")
    scratch.drop("lists", "index")
    wanted.destroy()
    reps = members.groupBy("sig").agg(F.min(F.struct("rare", "sid", "n")).alias("rep"))
    reps = scratch.keep(reps.select("sig", "rep.sid", "rep.n", "rep.rare").toDF("sig", "rep", "rep_n", "rep_rare"), "reps")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs whose parities do not rule a link out."""
        known = sets.select("sid", "n", "parity")
        pairs = pairs.join(known.toDF("a", "n_a", "parity_a"), "a").join(known.toDF("b", "n_b", "parity_b"), "b")
        pairs = pairs.select("a", "b", "n_a", "parity_a", "n_b", "parity_b")
        return pairs.mapInArrow(lambda it: _near(it, percent), "a long, b long")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link.

        The text of a meets those of its partners once for each ``VERIFY`` of them.
        """
        pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
        shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / VERIFY).cast("int").alias("shares"))
        shares = scratch.keep(shares, f"{name}-shares")
        dealt = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"), "b")
        whole = shares.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("a", "share", F.lit(None).cast("bigint").alias("b"))
        whole = whole.join(texts.withColumnRenamed("sid", "a"), "a").select("a", "share", "b", "text")
        dealt = dealt.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "share", "b", "text")
        full = dealt.unionByName(whole).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
        found = full.mapInArrow(lambda it: _verify(it, shingle, percent), "a long, b long")
        found = scratch.keep(found, f"{name}-links")
        scratch.drop(f"{name}-pairs", f"{name}-shares")
        return found

    unlike = (F.col("rare") + F.col("rep_rare")) * (100 + percent) > (F.col("n") + F.col("rep_n")) * (100 - percent)
    star = members.join(reps, "sig").filter(
        (F.col("sid") != F.col("rep")) & _size_ok(F.col("n"), F.col("rep_n"), percent) & ~(F.col("pair") & unlike)
    ).select(F.least("sid", "rep").alias("a"), F.greatest("sid", "rep").alias("b"))
    labels = sets.select("sid", F.struct(*KEY, "sid").alias("label"))
    edges = verified(near(scratch.keep(star.distinct(), "stars")), "star")
    scratch.drop("reps", "stars")
    stars = scratch.keep(components(edges, labels, scratch, "star-parts"), "star-parts")

    # lists whose members are not all in one component yet
    own = members.join(stars.select("sid", F.col("label.sid").alias("to")), "sid", "left")
    own = scratch.keep(own.select("sig", "sid", "n", "rare", "pair", F.coalesce("to", "sid").alias("comp")), "own")
    scratch.drop("members")
    open_lists = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
    part = scratch.keep(own.join(open_lists, "sig"), "open")
    part = spread(part, "sig", F.count(F.lit(1)) <= SIDE, F.ceil(F.count(F.lit(1)) / SIDE), percent)
    part = in_blocks(part.join(sets.select("sid", "parity"), "sid"))
    across = part.mapInArrow(lambda it: _blocks(it, percent), "a long, b long")
    edges = edges.unionByName(verified(across, "across"))
    parts = scratch.keep(components(edges, labels, scratch, "parts"), "parts")
    scratch.drop("own", "open")

    found = sets.join(parts, "sid", "left").select(
        "sid", "copies", F.coalesce("label", F.struct(*KEY, "sid")).alias("label")
    )
    if links:
        found = found.join(_links(sets, parts, edges, texts, scratch, shingle, percent), "sid", "left")
        found = found.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).drop("links")
    found = scratch.keep(found, "found")
    # as in exact_dedup, at most a thousand sets have more than a thousandth of the rows
    limit = max(100, -(-rows.count() // 1000))
    hot = F.broadcast(found.filter(F.col("copies") > limit))
    rows = rows.drop("raw", "check", "parity")
    full, bare = rows.filter("n > 0"), rows.filter("n = 0")
    cold = full.join(hot.select("sid"), "sid", "left_anti")
    both = full.join(hot, "sid").unionByName(cold.join(found, "sid"))
    more = ["n_links"] if links else []
    is_first = (F.col("nil") == F.col("label.nil")) & (F.col("doc") == F.col("label.doc"))
    is_first &= (F.col("t1") == F.col("label.t1")) & (F.col("t2") == F.col("label.t2"))
    own_id, least = F.when(F.col("nil") == 0, F.col("doc")), F.when(F.col("label.nil") == 0, F.col("label.doc"))
    both = both.select(own_id.alias(id_col), F.col("n").alias("n_shingles"), least.alias("component_id"), is_first.alias("first"), "t1", "t2", *more)
    bare = bare.select(own_id.alias(id_col), F.col("n").alias("n_shingles"), own_id.alias("component_id"), F.lit(True).alias("first"), "t1", "t2", *[F.lit(0).cast("bigint").alias(c) for c in more])
    return both.unionByName(bare)


def _key(id_col: str, text_col: str) -> list[Column]:
    """nil, doc, t1 and t2: rows that have them in common have the same id, or none, and the same text."""
    nil, text = F.col(id_col).isNull().cast("int"), F.col(text_col)
    return [nil, F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _links(
    sets: DataFrame, parts: DataFrame, edges: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, percent: int
) -> DataFrame:
    """(sid, links): the number of rows with other sets that a set links with.

    Where every pair of a component has been verified already, its edges are counted;
    the others are compared in blocks.
    """
    known = parts.select("sid", F.col("label.sid").alias("comp")).join(sets.select("sid", "n", "copies"), "sid")
    known = scratch.keep(known, "linked")
    both = scratch.keep(edges.select("a", "b").distinct(), "edges")
    pairs = both.join(known.select(F.col("sid").alias("a"), "comp"), "a").groupBy("comp").agg(F.count(F.lit(1)).alias("pairs"))
    size = known.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    whole = pairs.join(size, "comp").filter(F.col("pairs") * 2 == F.col("size") * (F.col("size") - 1)).select("comp")
    whole = scratch.keep(whole, "whole")
    done = known.join(whole, "comp", "left_semi")
    ends = both.toDF("sid", "to").unionByName(both.select(F.col("b").alias("sid"), F.col("a").alias("to")))
    summed = ends.join(done.select(F.col("sid").alias("to"), "copies"), "to").select("sid", F.col("copies").alias("links"))
    rest = scratch.keep(known.join(whole, "comp", "left_anti"), "rest")
    amount = [F.count(F.lit(1)) / LINK_SIDE, F.sum("n") / LINK_ELEMENTS]
    blocks = spread(rest, "comp", F.greatest(*amount) <= 1, F.ceil(F.greatest(*amount)), percent)
    counted = in_blocks(blocks.join(texts, "sid")).mapInArrow(lambda it: _link_counts(it, shingle, percent), "sid long, links long")
    return scratch.keep(counted.unionByName(summed).groupBy("sid").agg(F.sum("links").alias("links")), "links")


def jaccard_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component that with the smallest id.

    Of rows with the same id and text one stays.
    """
    names = fresh(df, *KEY)
    kept = jaccard_components(df, id_col, text_col, shingle, percent).filter("first")
    kept = kept.select(F.col(id_col).isNull().cast("int"), F.coalesce(id_col, F.lit(0)), "t1", "t2").toDF(*names).distinct()
    marked = df.withColumns(dict(zip(names, _key(id_col, text_col), strict=True)))
    return marked.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
