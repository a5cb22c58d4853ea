"""Language identification by rank-order n-gram profiles.

A text is lower-cased; everything that is no letter separates words.  Its n-grams
are the letters, the pairs and the triples around a letter, with one mark for a
word's edge.  A language's profile is the ``top`` most frequent n-grams of its
training texts, by rank.  A text's own ``top`` n-grams are compared to each
profile: an n-gram costs the difference of its two ranks (its out-of-place
distance), or ``top`` if the profile lacks it.  The language of least cost wins,
ties by name.  The score is 1 less the cost as a share of the largest possible.

Profiles are learned from at most ``PER_LANGUAGE`` texts of each language, chosen
by a hash of their ids.  Every text is scored whole.  A null text or one without
letters is ``und`` with score 0, and so is any text when nothing was learned.
N-grams are counted in blocks of ``BLOCK`` code points, so memory follows the
distinct n-grams of a long text.  Repeated rows get equal results.  Other columns
stay, but for lang_pred and lang_score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.rows import schema_of, without
from gapline.llm.textkernel import bound_arrow_batches, tidy

#: Training texts of a language: at most so many of each of SALTS shares.
SALTS, PER_SALT = 64, 16
PER_LANGUAGE = SALTS * PER_SALT
TOP = 400
#: Sampled ids that may be broadcast.
FEW = 200_000
EDGE = 32
#: Code points of a text worked on at once.
BLOCK = 1 << 16
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _block(points: np.ndarray, more: int) -> np.ndarray:
    """Codes of the n-grams that begin in all but the last ``more`` of the points."""
    letter = points != EDGE
    points = points.astype(np.int64)
    n = len(points) - more
    pairs = (points[:-1] << 21) | points[1:]
    triples = (pairs[:-1] << 21) | points[2:]
    singles, twos, threes = points[:n], pairs[:n], triples[:n]
    around = letter[:-1] | letter[1:]
    return np.concatenate([singles[letter[:n]], twos[around[: len(twos)]], threes[letter[1:-1][: len(threes)]]])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the n-grams, 21 bits for each code point; their counts), ascending by code."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "ignore"), np.uint32)
    parts = []
    for lo in range(0, len(points), BLOCK):
        # with the point before and two behind, or the text's edges
        part = points[max(0, lo - 1) : lo + BLOCK + 1]
        part = np.where(letters()[part], part, EDGE)
        ends = lo + BLOCK + 1 > len(points) or lo + BLOCK == len(points)
        part = np.concatenate([part if lo else np.append(EDGE, part), [EDGE] * ends])
        parts.append(np.unique(_block(part, 0 if ends else 2), return_counts=True))
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts."""
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
    codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    counts = np.zeros(len(codes), np.int64)
    np.add.at(counts, back, np.concatenate([n for _, n in parts]))
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, by falling count, then by code."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(lang, []).append(ngrams(text.as_py() or ""))
        for lang, parts in by.items():
            codes, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))],
                names=["lang", "code", "n"],
            )


def learn_profiles(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP
) -> dict[str, list[int]]:
    """Language -> n-gram codes by rank, from the rows of ``df`` whose language is not null."""
    spark = df.sparkSession
    known = df.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    order = F.xxhash64(F.lit("sample"), "__id")
    window = Window.partitionBy("__lang", "salt").orderBy("order", "__id")
    picked = (
        known.withColumns({"order": order, "salt": F.pmod(order, F.lit(SALTS))})
        .withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= PER_SALT)
        .select("__id", "__lang")
        .distinct()
    )
    ids = picked.limit(FEW + 1).collect()
    if not ids:
        return {}
    if len(ids) <= FEW:
        picked = F.broadcast(spark.createDataFrame(ids, picked.schema))
    texts = df.join(picked, (df[id_col] == picked["__id"]) & (df[lang_col] == picked["__lang"])).select("__lang", text_col)
    counts = texts.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("lang", "rank", "code")
    profiles: dict[str, list[int]] = {}
    for row in rows.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


class Profiles:
    """Profiles ready for comparison."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(k for k, codes in profiles.items() if codes), top
        self.tables = []
        for name in self.names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text or ""), self.top)
        if not len(own) or not self.names:
            return "und", 0.0
        ranks, best = np.arange(len(own)), ("und", None)
        for name, (codes, places) in zip(self.names, self.tables, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            cost = np.where(codes[at] == own, np.abs(places[at] - ranks), self.top).sum()
            if best[1] is None or cost < best[1]:
                best = (name, cost)
        return best[0], 1.0 - float(best[1]) / (self.top * len(own))


@tidy
def _judge(batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], top: int, at: int) -> Iterator[pa.RecordBatch]:
    judge = Profiles(profiles, top)
    for batch in batches:
        found = [judge.judge(x.as_py()) for x in batch.column(at)]
        new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "lang_score"])


def predict_language(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """``df`` with lang_pred and lang_score."""
    bound_arrow_batches(df.sparkSession)
    df = without(df, "lang_pred", "lang_score")
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(profiles)
    return df.mapInArrow(lambda it: _judge(it, sent.value, top, at), schema_of(df, "lang_pred string", "lang_score double"))
