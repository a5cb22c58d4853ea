"""Benchmark contamination found by one Aho-Corasick scan.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z:
letters, digits and everything outside ASCII.  A window is ``window`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window.
A document word inside any occurrence of any window is hit.

A benchmark word is a symbol of its own, all others of the corpus are one symbol
that occurs in no window.  The windows, as strings of symbols, make one automaton,
which takes ten nodes for a benchmark word at most.  Every text is normalised by
byte tables, spelled in symbols and scanned once; a place in the spelled text is a
word's number, which leads back to byte offsets of the original.

A benchmark of more than ``SHARE`` bytes is dealt into shares of about that size
by the hash of the text; each share makes an automaton of its own and a scan that
writes the hits alone, so one share at a time is on the driver and in a worker.
The automaton is built once in a worker.

Null texts have no words.  An item without words has no window.  Repeated rows
get equal results.  Items with equal windows are all counted; item ids may be of
any type.  Other columns stay, but those named like the result's are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.rows import fresh, schema_of, without
from gapline.llm.store import Scratch
from gapline.llm.textkernel import bound_arrow_batches, tidy

#: Bytes of benchmark text in one automaton.  So few hold fewer distinct words than there are symbols.
SHARE = 4 << 20
#: Upper case goes to lower case, other ASCII but digits and letters to space.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def item_windows(text: bytes, window: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


class Matcher:
    """Finds the windows of benchmark items in texts."""

    def __init__(self, items: list[tuple[Any, bytes]], window: int):
        import ahocorasick

        owners: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            for w in item_windows(text, window):
                owners.setdefault(w, []).append(k)
        self.names = [item for item, _ in items]
        self.symbols = {w: chr(k) for k, w in enumerate(dict.fromkeys(w for own in owners for w in own.split(b" ")), 1)}
        self.trie = ahocorasick.Automaton()
        for w, own in owners.items():
            spelled = "".join(self.symbols[x] for x in w.split(b" "))
            self.trie.add_word(spelled, (len(spelled), tuple(own)))
        if owners:
            self.trie.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[Any]]:
        """(ranges of hit word numbers, distinct items)."""
        if not len(self.trie) or not words:
            return [], []
        line = "".join(map(self.symbols.get, words, repeat("\0")))
        found, items = [], set()
        for last, (n, own) in self.trie.iter(line):
            found.append((last + 1 - n, last + 1))
            items.update(own)
        return found, list({self.names[k] for k in items})


Share = tuple[str, list[tuple[Any, bytes]], int]


@lru_cache(maxsize=1)
def _matcher(name: str, share: Callable[[], Share]) -> Matcher:
    _, items, window = share()
    return Matcher(items, window)


class _Sent:
    """A broadcast share, known by its name."""

    def __init__(self, sent, name: str):
        self.sent, self.name = sent, name

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Sent) and other.name == self.name

    def __call__(self) -> Share:
        return self.sent.value

    def matcher(self) -> Matcher:
        return _matcher(self.name, self)


def byte_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of word numbers as byte offsets of the original text."""
    plain = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


ADDED = {
    "n_words": "long",
    "n_hit": "long",
    "n_items": "long",
    "items_sha256": "string",
    "contaminated": "boolean",
    "hit_bytes": "array<struct<start:int,end:int>>",
}
RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RANGES_SQL = "array<struct<start:int,end:int>>"


def _pairs(ranges: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], RANGES)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges merged where they touch, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digest(items: list[Any]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _describe(text: pa.Scalar, words: int, ranges: list[tuple[int, int]], items: list[Any]) -> tuple:
    """The result's columns for one text; ranges are merged, items distinct."""
    n_hit = sum(b - a for a, b in ranges)
    spans = byte_spans(text.as_buffer().to_pybytes(), ranges) if ranges else []
    return words, n_hit, len(items), _digest(items), n_hit > 0, spans


def _added(batch: pa.RecordBatch, rows: list[tuple], keep: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    new = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)] + [_pairs([r[5] for r in rows])]
    return pa.RecordBatch.from_arrays([*batch.columns[:keep], *new], names=[*batch.schema.names[:keep], *ADDED])


def _words(text: pa.Scalar) -> list[bytes]:
    return words_of(text.as_buffer().to_pybytes()) if text.is_valid else []


@tidy
def _scan(batches: Iterator[pa.RecordBatch], share: _Sent, text_at: int) -> Iterator[pa.RecordBatch]:
    """The only scan of a benchmark of one share."""
    finder = share.matcher()
    for batch in batches:
        out = []
        for text in batch.column(text_at):
            words = _words(text)
            ranges, items = finder.find(words)
            out.append(_describe(text, len(words), _union(ranges), items))
        yield _added(batch, out, batch.num_columns)


@tidy
def _hits(batches: Iterator[pa.RecordBatch], share: _Sent) -> Iterator[pa.RecordBatch]:
    """The texts with hits.  Columns: t1, t2, text; out: t1, t2, merged ranges, numbers of items."""
    finder = share.matcher()
    for batch in batches:
        at, spans, items = [], [], []
        for i, text in enumerate(batch.column(2)):
            ranges, own = finder.find(_words(text))
            if ranges:
                at.append(i)
                spans.append(_union(ranges))
                items.append(own)
        rows = pa.array(at, pa.int64())
        made = [batch.column(0).take(rows), batch.column(1).take(rows), _pairs(spans), pa.array(items, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, names=["t1", "t2", "ranges", "items"])


@tidy
def _finish(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The result's columns from the hits of all scans, which the last two columns hold."""
    for batch in batches:
        out = []
        found = zip(*(batch.column(k).to_pylist() for k in (-2, -1)), strict=True)
        for text, (ranges, items) in zip(batch.column(text_at), found, strict=True):
            merged = _union([(x["start"], x["end"]) for r in ranges or [] for x in r])
            out.append(_describe(text, len(_words(text)), merged, list({x for i in items or [] for x in i})))
        yield _added(batch, out, batch.num_columns - 2)


def mark_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    share: int = SHARE,
) -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items_sha256, contaminated and hit_bytes (offsets in UTF-8)."""
    spark = df.sparkSession
    bound_arrow_batches(spark)
    df = without(df, *ADDED)
    at = df.columns.index(text_col)
    schema = schema_of(df, *(f"{c} {t}" for c, t in ADDED.items()))
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    shares = max(1, -(-size // share))

    def send(part: DataFrame, item: str) -> _Sent:
        rows = [(r[0], (r[1] or "").encode()) for r in part.select(item, "text").collect()]
        name = uuid.uuid4().hex
        return _Sent(spark.sparkContext.broadcast((name, rows, window)), name)

    label = F.coalesce(F.col(item_col).cast("string"), F.lit("None")).alias("name")
    items = benchmark.select(F.monotonically_increasing_id().alias("k"), label, F.col(item_text).alias("text"))
    if shares == 1:
        sent = send(items, "name")
        return df.mapInArrow(lambda it: _scan(it, sent, at), schema)
    scratch = Scratch(spark, "benchmark")
    items = scratch.keep(items, "items")
    twins = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)]
    texts = df.select(twins[0].alias("t1"), twins[1].alias("t2"), F.col(text_col).alias("text"))
    hits = None
    for k in range(shares):
        sent = send(items.filter(F.pmod(F.xxhash64("text"), F.lit(shares)) == k), "k")
        found = texts.mapInArrow(lambda it, sent=sent: _hits(it, sent), f"t1 long, t2 long, ranges {RANGES_SQL}, items array<bigint>")
        found = scratch.keep(found.dropDuplicates(["t1", "t2"]), f"hits-{k}")
        sent.sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    names = scratch.keep(
        hits.select("t1", "t2", F.explode("items").alias("k")).join(items.select("k", "name"), "k").groupBy("t1", "t2").agg(F.collect_set("name").alias("items")),
        "names",
    )
    own = fresh(df, "t1", "t2", "ranges", "items")
    both = hits.groupBy("t1", "t2").agg(F.collect_list("ranges").alias("ranges")).join(names, ["t1", "t2"])
    both = scratch.keep(both.select("t1", "t2", "ranges", F.array("items").alias("items")).toDF(*own), "both")
    marked = df.withColumns(dict(zip(own[:2], twins, strict=True))).join(both, own[:2], "left").select(*df.columns, *own[2:])
    return marked.mapInArrow(lambda it: _finish(it, at), schema)
