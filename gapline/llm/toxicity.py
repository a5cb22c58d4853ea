"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms and accents are undone, letters of
other scripts that look like Latin ones and digits or signs that stand for
letters become those letters, but for numbers of their own, and everything else
but letters separates words.
The lexicon holds whole words and word beginnings with weights (log ratios of
document frequencies).  An exception phrase cancels the matches inside it.

A text's evidence is the sum over its terms of weight times occurrences (at most
``REPEATS`` of a term), divided by ``1 + ln(1 + words / LENGTH)``; the score is
``1 - exp(-rate * evidence)``.  A text without matches, an empty and a null text
score 0.  Repeated rows score alike.  Other columns stay, but for toxicity, which
is replaced.

The lexicon and the rate are learned from at most ``SAMPLE`` labelled rows, chosen
by a hash of their ids.  Copies would make the words of one text look typical, so
of texts with the same least word hash one counts.  Every text is scored whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.rows import schema_of, without
from gapline.llm.store import Scratch
from gapline.llm.textkernel import FOLD, Hasher, bound_arrow_batches, find_words, pieces, signed, tidy

#: Labelled rows to learn from.
SAMPLE = 12_000
#: Least share of toxic texts with a term, and its least weight.
SUPPORT, WEIGHT = 0.02, 3.0
#: Chance of a term that only looks toxic.
CHANCE = 0.01
#: Lengths of word beginnings.
SHORT, LONG = 4, 12
REPEATS, LENGTH = 5, 200
#: Words in a row whose least hash tells copies.
COPY = 5
THRESHOLD = 0.7

#: Small Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
        "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
        "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    }
)
#: Digits and signs that stand for letters.
STAND_INS = str.maketrans("013457@$", "oieastas")
OTHER = re.compile("[\u0370-\u052f]")
MARKS = re.compile("[\u0300-\u036f\u200b-\u200f\u2060\ufeff\u00ad]+")
SPLIT = re.compile(r"[\W_]+")
#: Numbers of their own, which stand for no letters.
NUMBER = re.compile(r"(?<![^\W_])(?<![@$])[0-9]+(?![^\W_])(?![@$])")
#: Harmless phrases with words that are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "idiot proof", "pond scum")


def fold(text: str | None) -> str:
    """The folded words between single spaces, with a space at either end."""
    text = text or ""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().replace("ß", "ss").replace("ı", "i")
        if OTHER.search(text):
            text = text.translate(LOOKALIKES)
    return f" {SPLIT.sub(' ', NUMBER.sub('9', text.lower()).translate(STAND_INS)).strip()} "


def terms_of(words: Iterable[str]) -> set[str]:
    """Word beginnings, and whole words closed by a space."""
    out = set()
    for w in words:
        out.add(w + " ")
        out.update(w[:k] for k in range(SHORT, min(len(w), LONG) + 1))
    return out


@dataclass
class Lexicon:
    """Terms (``word `` or ``beginning``) with weights, phrases that cancel, and the score's rate."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    rate: float = 1.0


class Scorer:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.rate = lexicon.rate
        self.trie = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.trie.add_word(" " + term, (len(term) + 1, term, weight))
        for phrase in lexicon.exceptions:
            words = fold(phrase)
            if words not in self.trie and words.strip():
                self.trie.add_word(words, (len(words), None, 0.0))
        if len(self.trie):
            self.trie.make_automaton()

    def evidence(self, text: str | None) -> float:
        if not text or not len(self.trie):
            return 0.0
        line = fold(text)
        hits, quiet = [], []
        for end, (length, term, weight) in self.trie.iter(line):
            if term is None:
                quiet.append((end - length + 1, end))
            else:
                hits.append((end - length + 1, end, term, weight))
        if not hits:
            return 0.0
        counts: Counter = Counter()
        # both by their beginnings: the furthest end of the phrases begun so far tells whether one holds the match
        hits.sort(key=itemgetter(0))
        quiet.sort()
        reach, k = -1, 0
        for a, b, term, weight in hits:
            while k < len(quiet) and quiet[k][0] <= a:
                reach, k = max(reach, quiet[k][1]), k + 1
            if b > reach:
                counts[term, weight] += 1
        total = sum(weight * min(n, REPEATS) for (_, weight), n in counts.items())
        return total / (1 + math.log1p((line.count(" ") - 1) / LENGTH))

    def score(self, text: str | None) -> float:
        return 1.0 - math.exp(-self.rate * max(0.0, self.evidence(text)))


def _flush(counts: dict, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
        names=names,
    )


@tidy
def _terms(batches: Iterator[pa.RecordBatch], wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
    """(term, label, number of texts), added up for a part of the partition."""
    counts: Counter = Counter()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = terms_of(set(fold(text).split()))
            counts.update((t, label) for t in (found if wanted is None else found & wanted))
            if len(counts) > 200_000:
                yield _flush(counts, ["term", "label", "n"])
                counts = Counter()
    if counts:
        yield _flush(counts, ["term", "label", "n"])


@tidy
def _words(batches: Iterator[pa.RecordBatch], stems: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole words that begin with a stem."""
    counts: Counter = Counter()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((w, label) for w in set(fold(text).split()) if w.startswith(stems))
    if counts:
        yield _flush(counts, ["term", "label", "n"])


@tidy
def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the least hash of their word sequences of length ``COPY``."""
    hasher = Hasher(41)
    for batch in batches:
        least = np.zeros(batch.num_rows, np.uint64)
        for lo, hi, data, bounds in pieces(batch.column(1)):
            starts, ends, first = find_words(data, bounds)
            words = hasher.words(FOLD[data], starts, ends)
            grams = hasher.grams(words, COPY)
            for k in range(lo, hi):
                a, b = first[k - lo], first[k - lo + 1]
                if b - a >= COPY:
                    least[k] = grams[a : b - COPY + 1].min()
                elif b > a:
                    least[k] = hasher.ranges(words, np.array([a]), np.array([b]))[0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(least))], names=["label", "text", "least"])


def poisson_tail(n: int, mean: float) -> float:
    """Chance of at least ``n`` events where ``mean`` are expected."""
    term, below = math.exp(-mean), 0.0
    for k in range(n):
        below += term
        term *= mean / (k + 1)
        if term < below * 1e-17:
            break
    # far in the tail the sum from n on is exact where 1 - below is not
    term = math.exp(n * math.log(mean) - mean - math.lgamma(n + 1)) if mean > 0 else 0.0
    above, k = 0.0, n
    while term > above * 1e-12:
        above += term
        k += 1
        term *= mean / k
    return min(1.0, above if n > mean else 1.0 - below)


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms that many toxic and few clean texts hold, each as long as it keeps its texts.

    A term counts if, at the clean texts' rate, so many toxic texts would hold it by
    chance at most with probability ``CHANCE``, over all terms together.
    """
    support = max(3, math.ceil(SUPPORT * n_toxic))
    below: dict[str, list[str]] = {}
    for t in toxic:
        below.setdefault(t[:-1], []).append(t)

    def weight(t: str) -> float:
        return math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))

    def sound(t: str) -> bool:
        expected = n_toxic * (clean.get(t, 0) + 0.5) / (n_clean + 1)
        return weight(t) >= WEIGHT and poisson_tail(toxic[t], expected) * len(toxic) <= CHANCE

    out: dict[str, float] = {}
    todo = [t for t in toxic if len(t) == SHORT and not t.endswith(" ") or t.endswith(" ") and len(t) <= SHORT]
    while todo:
        t = todo.pop()
        if toxic[t] < support:
            continue
        if not sound(t):
            todo += below.get(t, [])
            continue
        while longer := [c for c in below.get(t, []) if toxic[c] >= 0.9 * toxic[t] and sound(c)]:
            t = max(longer, key=lambda c: (toxic[c], c))
        out[t] = weight(t)
    return out


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> Lexicon:
    """The lexicon of the labelled rows in ``labels``."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    scratch = Scratch(spark, "toxicity")
    picked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit("sample"), "__id"), "__id", "label")
        .limit(sample)
    )
    picked = spark.createDataFrame(picked.collect(), "__id long, label int")
    texts = docs.join(F.broadcast(picked), docs[id_col] == F.col("__id")).select("label", F.col(text_col).alias("text"))
    texts = texts.mapInArrow(_signature, "label int, text string, least long").dropDuplicates(["label", "least"]).drop("least")
    texts = scratch.keep(texts, "texts")
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()

    def counted(df: DataFrame, function, least: int) -> list:
        made = df.mapInArrow(function, "term string, label int, n long")
        return made.groupBy("term", "label").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()

    support = max(3, math.ceil(SUPPORT * n_toxic))
    toxic = {r["term"]: r["n"] for r in counted(texts.filter("label = 1"), lambda it: _terms(it, None), support)}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {r["term"]: r["n"] for r in counted(texts.filter("label = 0"), lambda it: _terms(it, wanted.value), 1)}
    weights = choose_terms(toxic, clean, n_toxic, n_clean)
    if not weights:
        return Lexicon()
    stems = tuple(t.rstrip() for t in weights)
    forms: dict[str, list[int]] = {}
    for r in counted(texts, lambda it: _words(it, stems), 1):
        forms.setdefault(r["term"], [0, 0])[r["label"] == 1] += r["n"]
    harmless = sorted(w for w, (c, t) in forms.items() if c / n_clean > t / n_toxic)
    lexicon = Lexicon(weights, (*EXCEPTIONS, *harmless))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in it:
            found = [scorer.evidence(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["label", "x"])

    points = sorted((r["x"], r["label"]) for r in texts.mapInArrow(measure, "label int, x double").collect())
    lexicon.rate = -math.log(1 - THRESHOLD) / _threshold(points, n_toxic, n_clean)
    return lexicon


def _threshold(points: list[tuple[float, int]], n_toxic: int, n_clean: int) -> float:
    """The evidence above which texts are toxic: of best balanced accuracy, midway between two points."""
    best, at, toxic_below, clean_below = -1.0, 1.0, 0, 0
    for k, (x, label) in enumerate(points[:-1]):
        toxic_below, clean_below = toxic_below + (label == 1), clean_below + (label == 0)
        after = points[k + 1][0]
        if after > x and (gain := clean_below / n_clean + 1 - toxic_below / n_toxic) > best:
            best, at = gain, (x + after) / 2
    return at


@tidy
def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, at: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(lexicon)
    for batch in batches:
        scores = pa.array([scorer.score(x.as_py()) for x in batch.column(at)], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "toxicity"])


def score_toxicity(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``toxicity`` from 0 to 1."""
    bound_arrow_batches(df.sparkSession)
    df = without(df, "toxicity")
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(lexicon)
    return df.mapInArrow(lambda it: _score(it, sent.value, at), schema_of(df, "toxicity double"))
