"""Removal of long word sequences that an earlier document holds too.

A window is ``window`` consecutive words of one document.  A word goes when a
window that covers it also starts in a document with a smaller id.  Windows are
judged on the input.

1. Neighbouring windows that have the same smallest ``GRAM``-word hash form a
   run, and that hash is their key: equal windows share it.  Every partition
   counts the documents of each key in a count-min sketch of ``DEPTH`` rows; the
   sketches are merged by addition.  A window's estimate is never below the
   number of documents that hold it.
2. Only runs whose estimate is above one go on.  Equal runs (128-bit hashes of
   all their words) are grouped exactly first: each occurrence but that of the
   smallest id is covered as a whole.
3. The runs' first occurrences are opened into single windows, which a sketch of
   their own prefilters in the same way before they too are grouped exactly by
   128-bit hashes.  A window that is in an earlier document too is
   covered; covered windows travel as bits, 64 to a row.

The sketch's width follows the number of runs up to ``widest`` counters a row;
beyond that more windows go to the exact pass, which changes no result.  Each
executor gets a bit for every counter (64 MB at most).  Hot runs and windows only
ever meet in aggregations with partial sums and in joins of written tables, whose
large partitions Spark splits.

Null text counts as empty.  A null id counts as 2**63 - 1.  Rows with the same id
never remove words from each other; repeated rows get equal results.  Texts of
fewer words than a window keep all of them.  Other columns stay, whatever their
names, but for those named n_words, n_removed and kept_text, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm import sketch
from gapline.llm.rows import KEY, fresh, row_key, schema_of, without
from gapline.llm.store import Scratch
from gapline.llm.textkernel import Hasher, bound_arrow_batches, find_words, pieces, signed, tidy

GRAM = 10
#: Rows of the sketch, and documents' keys to a counter.
DEPTH, LOAD = 2, 0.5


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]


@tidy
def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    one, two = Hasher(11), Hasher(12)
    gram = min(GRAM, window)
    for batch in batches:
        key = _keys(batch)
        for lo, hi, data, bounds in pieces(batch.column(3)):
            starts, ends, first = find_words(data, bounds)
            if not (np.diff(first) >= window).any():
                continue
            words, others = one.words(data, starts, ends), two.words(data, starts, ends)
            low = _sliding_min(one.grams(words, gram), window - gram + 1)
            # windows that lie in one text
            doc = np.repeat(np.arange(hi - lo), np.diff(first))[: len(low)]
            inside = np.arange(len(low)) + window <= first[doc + 1]
            place = np.flatnonzero(inside)
            low, doc = low[place], doc[place]
            new = np.ones(len(place), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(place)))
            begin = place[head]
            end = begin + count + window - 1
            rows = lo + doc[head]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(low[head])),
                    pa.array(signed(one.ranges(words, begin, end))),
                    pa.array(signed(two.ranges(others, begin, end))),
                    *[pa.array(k[rows]) for k in key],
                    pa.array((begin - first[doc[head]]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                names=["low", "r1", "r2", *KEY, "at", "n"],
            )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The keys, once for each document of a batch.  Columns: low, doc, t1, t2."""
    for batch in batches:
        low, doc, t1, t2 = (batch.column(k).to_numpy() for k in range(4))
        new = np.ones(len(low), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
        number = np.cumsum(new)
        order = np.lexsort((low, number))
        low, number = low[order], number[order]
        once = np.ones(len(low), bool)
        once[1:] = (low[1:] != low[:-1]) | (number[1:] != number[:-1])
        yield low[once].view(np.uint64)


def document_sketch(runs: DataFrame, width: int) -> DataFrame:
    """The merged sketch of the documents of each key; a row for each segment."""
    keys = runs.select("low", *KEY)
    parts = keys.mapInArrow(lambda it: sketch.partial(_documents(it), DEPTH, width), sketch.SCHEMA)
    return sketch.merged(parts, keys.rdd.getNumPartitions())


@tidy
def _repeated(batches: Iterator[pa.RecordBatch], bits: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The runs whose estimate is above one."""
    for batch in batches:
        low = batch.column(0).to_numpy().view(np.uint64)
        yield batch.filter(pa.array(sketch.all_set(low, bits, DEPTH, width)))


@tidy
def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The single windows of the listed runs.  Columns: key, text, runs of (at, n)."""
    one, two = Hasher(11), Hasher(12)
    for batch in batches:
        key = _keys(batch)
        runs = batch.column(4)
        for lo, hi, data, bounds in pieces(batch.column(3)):
            starts, ends, first = find_words(data, bounds)
            words, others = one.words(data, starts, ends), two.words(data, starts, ends)
            part = runs.slice(lo, hi - lo)
            flat, sizes = part.flatten(), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(hi - lo), sizes)
            begin = np.repeat(first[row] + at, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            begin = np.unique(begin)
            row = np.searchsorted(first, begin, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(one.grams(words, window)[begin])),
                    pa.array(signed(two.grams(others, window)[begin])),
                    *[pa.array(k[lo + row]) for k in key],
                    pa.array((begin - first[row]).astype(np.int32)),
                ],
                names=["w1", "w2", *KEY, "at"],
            )


def _fields(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """The row of each list's element, and the element's fields."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(flat.field(k).to_numpy(zero_copy_only=False) for k in names)


@tidy
def _remove(batches: Iterator[pa.RecordBatch], text_at: int, window: int) -> Iterator[pa.RecordBatch]:
    """Cut the covered words out; the last two columns have covered ranges, and bits of covered windows."""
    shifts = np.arange(64, dtype=np.uint64)
    for batch in batches:
        texts, last = batch.column(text_at), batch.num_columns - 1
        row, begin, end = _fields(batch.column(last - 1), "begin", "end")
        own, block, mask = _fields(batch.column(last), "block", "mask")
        where, bit = np.nonzero((mask.view(np.uint64)[:, None] >> shifts) & np.uint64(1))
        at = block[where] * 64 + bit
        row, begin, end = np.concatenate([row, own[where]]), np.concatenate([begin, at]), np.concatenate([end, at + window])
        order = np.argsort(row, kind="stable")
        row, begin, end = row[order], begin[order], end[order]
        stops = np.searchsorted(row, np.arange(batch.num_rows + 1))
        n_words, n_removed, kept = [], [], []
        for i in range(batch.num_rows):
            text = texts[i]
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            part = slice(stops[i], stops[i + 1])
            if part.start < part.stop:
                edges = np.bincount(begin[part], minlength=len(words) + 1) - np.bincount(end[part], minlength=len(words) + 1)
                stay = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
                words = [words[k] for k in stay]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        names = batch.schema.names[:-2]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=[*names, "n_words", "n_removed", "kept_text"])


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, widest: int = sketch.WIDE
) -> DataFrame:
    """``df`` with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    spark = df.sparkSession
    bound_arrow_batches(spark)
    scratch = Scratch(spark, "substring")
    df = without(df, "n_words", "n_removed", "kept_text")
    docs = df.select(*[c.alias(k) for k, c in row_key(df, id_col, text_col).items()], F.col(text_col).alias("text"))
    key = "doc long, t1 long, t2 long"

    runs = scratch.keep(
        docs.mapInArrow(lambda it: _runs(it, window), f"low long, r1 long, r2 long, {key}, at int, n int"), "runs"
    )
    def repeated(rows: DataFrame, name: str) -> DataFrame:
        """The rows whose first column, their key, is estimated to stand in two documents."""
        width = min(sketch.width_for(rows.count(), LOAD), widest)
        counts = document_sketch(rows.withColumnRenamed(rows.columns[0], "low"), width)
        sent = spark.sparkContext.broadcast(sketch.reached(counts, 2, DEPTH, width))
        made = scratch.keep(rows.mapInArrow(lambda it: _repeated(it, sent.value, width), rows.schema), name)
        sent.destroy()
        return made

    again = repeated(runs, "again").drop("low")
    scratch.drop("runs")

    earliest = scratch.keep(again.groupBy("r1", "r2").agg(F.min("doc").alias("first")), "earliest")
    judged = scratch.keep(
        again.join(earliest, ["r1", "r2"]).select(*KEY, "at", "n", (F.col("doc") > F.col("first")).alias("later")), "judged"
    )
    scratch.drop("again", "earliest")

    opened = judged.filter("not later").groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    opened = scratch.keep(opened, "opened")
    windows = scratch.keep(
        docs.join(opened, KEY)
        .select(*KEY, "text", "runs")
        .mapInArrow(lambda it: _windows(it, window), f"w1 long, w2 long, {key}, at int"),
        "windows",
    )
    scratch.drop("opened")
    windows = repeated(windows, "likely")
    scratch.drop("windows")
    shared = scratch.keep(
        windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last"),
        "shared",
    )
    bit = F.expr("shiftleft(1L, at % 64)")
    single = windows.join(shared, ["w1", "w2"]).filter("doc > first").groupBy(*KEY, F.expr("at div 64").alias("block"))
    single = single.agg(F.bit_or(bit).alias("mask")).select(*KEY, F.struct("block", "mask").alias("single"), F.lit(None).alias("range"))
    ranges = judged.filter("later").select(
        *KEY, F.lit(None).alias("single"), F.struct(F.col("at").cast("bigint").alias("begin"), (F.col("at") + F.col("n") + window - 1).cast("bigint").alias("end")).alias("range")
    )
    found, bits = fresh(df, "ranges", "bits")
    marks = single.unionByName(ranges).groupBy(*KEY).agg(F.collect_list("range").alias(found), F.collect_list("single").alias(bits))
    names = fresh(df, *KEY)
    marks = scratch.keep(marks.toDF(*names, found, bits), "marks")
    scratch.drop("likely", "shared", "judged")

    marked = df.withColumns(dict(zip(names, row_key(df, id_col, text_col).values(), strict=True)))
    marked = marked.join(marks, names, "left").select(*df.columns, found, bits)
    at = df.columns.index(text_col)
    schema = schema_of(df, "n_words long", "n_removed long", "kept_text string")
    return marked.mapInArrow(lambda it: _remove(it, at, window), schema)
