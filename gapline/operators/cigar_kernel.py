"""CIGAR strings of whole Arrow batches, walked with arrays.

Every operation of a batch is one element: its length, its row, and the sums of
the lengths before it in the row on read, reference and matched bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LEFT, MIDDLE, RIGHT = 1, 2, 4
#: What an operation advances: read, reference, matched bases.
READ, REFERENCE, MATCHED = (np.array([chr(c) in kinds for c in range(256)]) for kinds in ("M=XSI", "M=XDN", "M=X"))
CUT = np.array([chr(c) in "SI" for c in range(256)])
OPERATION = np.array([chr(c) in "MIDNSHP=X" for c in range(256)])
MOST = (1 << 31) - 1


class Walk:
    """The operations of a column of CIGAR strings; null and ``*`` have none."""

    def __init__(self, cigars: pa.Array):
        cigars = cigars.cast(pa.large_string()).fill_null("")
        _, offsets, data = cigars.buffers()
        offsets = np.frombuffer(offsets, np.int64)[cigars.offset : cigars.offset + len(cigars) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        self.rows = len(cigars)
        place = np.flatnonzero(OPERATION[data])
        digit = np.flatnonzero((data >= 48) & (data <= 57))
        own = np.searchsorted(place, digit)  # the operation that a digit belongs to
        row = lambda at: np.searchsorted(offsets, at, "right")
        keep = own < len(place)
        keep[keep] = row(digit[keep]) == row(place[own[keep]])
        digit, own = digit[keep], own[keep]
        weight = 10.0 ** (place[own] - 1 - digit)
        size = np.bincount(own, (data[digit] - 48.0) * weight, len(place))
        good = (np.bincount(own, minlength=len(place)) > 0) & (size <= MOST)
        self.size, place = size[good].astype(np.int64), place[good]
        self.kind = data[place]
        self.row = np.searchsorted(offsets, place, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))  # each row's first operation

    def sums(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum before each operation within its row, sum of each row) of the operations whose kinds count."""
        total = np.concatenate([[0], np.cumsum(np.where(counted[self.kind], self.size, 0))])
        return total[:-1] - total[self.first[self.row]], total[self.first[1:]] - total[self.first[:-1]]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are null)"""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _int(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=null if null is not None and null.any() else None)


SPANS = "aln_end int, match_len int, read_len int"


def spans(batches: Iterator[pa.RecordBatch], cigar: int, pos: int) -> Iterator[pa.RecordBatch]:
    """The rows with the columns of ``SPANS``."""
    for batch in batches:
        walk = Walk(batch.column(cigar))
        at, null = _numbers(batch.column(pos))
        ends = [walk.sums(kinds)[1] for kinds in (REFERENCE, MATCHED, READ)]
        bare = batch.column(cigar).is_null().to_numpy(zero_copy_only=False)
        made = [_int(at + ends[0], null | bare), _int(ends[1], bare), _int(ends[2], bare)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "aln_end", "match_len", "read_len"])


SEGMENTS = f"{SPANS}, aln_type int, num_seg int, seg_order int, seg_type int, query_start int, query_end int, ref_pos int, overhang int"


def segments(batches: Iterator[pa.RecordBatch], cigar: int, pos: int, min_length: int, min_overhang: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each clip or insertion of at least ``min_length``, with the columns of ``SEGMENTS``."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for batch in batches:
        walk = Walk(batch.column(cigar))
        at, null = _numbers(batch.column(pos))
        (query, read_len), (ref, ref_len), (before, matched) = (walk.sums(kinds) for kinds in (READ, REFERENCE, MATCHED))
        found = np.flatnonzero(CUT[walk.kind] & (walk.size >= min_length))
        row, size = walk.row[found], walk.size[found]
        kind = np.where(found == walk.first[row], LEFT, np.where(found == walk.first[row + 1] - 1, RIGHT, MIDDLE))
        start = np.searchsorted(row, np.arange(walk.rows + 1))  # each row's first segment
        types = np.zeros(walk.rows, np.int64)
        np.bitwise_or.at(types, row, kind)
        before, whole = before[found], matched[row]
        over = np.where(kind == LEFT, whole, np.where(kind == MIDDLE, np.minimum(before, whole - before), before))
        keep = np.arange(len(found)) if min_overhang is None else np.flatnonzero(over >= min_overhang)
        row, hidden = row[keep], null[row[keep]]
        values = [
            (at + ref_len)[row], whole[keep], read_len[row], types[row], np.diff(start)[row], keep - start[row], kind[keep],
            query[found[keep]], (query[found] + size)[keep], at[row] + ref[found[keep]], over[keep],
        ]
        made = [_int(v, hidden if n in ("aln_end", "ref_pos") else None) for n, v in zip(names, values, strict=True)]
        own = [c.take(pa.array(row)) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*own, *made], names=[*batch.schema.names, *names])
