"""Packing of tokenised documents into sequences by vector best-fit.

A document becomes its token ids and the end id 1; only longer ones are cut, into
pieces of ``capacity`` ids.  A sequence has three capacities: tokens, documents
and attention cost (the sum of the squares of its pieces' lengths).  Pieces are
taken by decreasing length.  Of the open sequences in which a piece keeps every
capacity, that one is selected whose residual vector, after the piece, has the
smallest weighted norm (``norm``) or whose residual has the largest weighted
dot-product with the piece's demand (``dot``); without any, a sequence is opened.
The default limits on documents and cost are the largest that the token limit
allows, so they bind only where they are set lower.

Pieces are dealt by a hash of their place into groups of about ``GROUP``, each
packed in one task; a group wastes less than one sequence.  No key of the data
takes part, so nothing is skewed.  A full piece is a sequence of its own and is
not dealt.

Null text is an empty document, which has the end id alone.  Repeated rows are
packed each.  Text never becomes a special token.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.store import Scratch
from gapline.llm.textkernel import WHITESPACE, Hasher, bound_arrow_batches, equal_words, find_words, pieces, tidy

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY, END = 4096, 1
GROUP = 20_000
#: Weights of tokens, documents and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.01, 0.01)
#: Words of a kind whose ids a task remembers; about 200 bytes each.
KNOWN = 200_000
#: Bytes of text encoded at once.
ENCODED = 2 << 20
#: Byte-level vocabularies spell a byte by the character of its number, but for
#: bytes without a visible one, which are spelled by the characters from 256 on, in order.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN) if b >= 128}
#: Code points of the upper-case letters of plain words.
UPPER = [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]
#: Marks that may close a plain word.
MARKS = b".,;:!?"


def _plain_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes belong to Latin-1 letters, the bytes with those letters in lower case).

    In UTF-8 these are ASCII letters and the bytes of U+00C0 to U+00FF but for the
    signs of multiplication and division.
    """
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = data == 0xC3
    behind = np.zeros(len(data), bool)
    behind[1:] = lead[:-1]
    behind &= (data >= 0x80) & (data != 0x97) & (data != 0xB7)
    lower = data.copy()
    lower[ascii_letter] |= 32
    lower[behind & (data <= 0x9E)] += 32
    return ascii_letter | lead | behind, lower


class Encoder:
    """Token ids of whole texts, word by word.

    Where the tokenizer drops white space, which no token crosses, the ids of a text
    are those of its blank-separated words in turn.  A plain word, Latin-1 letters
    and at most one closing mark, has the ids of its lower-case letters, then that of
    the mark, since a token crosses from letters to marks as little; whether the
    given tokenizer is like that, letters' case included, is tried out first, and
    if not, no word is plain.  Distinct words of a piece of text are looked up
    once, and their ids are remembered.  Words are told apart by 64-bit hashes and
    then by their bytes.  New plain words are encoded many at once; a word's last
    token is of a kind of its own, which tells where its ids end.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        words = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(words.values()) + 1, bool)
        self.closes[[i for w, i in words.items() if w.endswith("</w>")]] = True
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        #: Whether white space leaves no trace in the ids; otherwise texts are encoded whole.
        blanks = map(chr, np.flatnonzero(WHITESPACE).tolist())
        self.by_word = all(one(f"{b}Ab{b}{b}cd.{b}") == one("Ab") + one("cd.") for b in blanks)
        #: Whether letters have the ids of their lower case; otherwise no word is plain.
        self.plain = self.by_word and all(
            one(a) == one(b) for a, b in [*((chr(c), chr(c).lower()) for c in UPPER), ("Ab", "ab"), ("aB", "ab"), ("THE", "the"), ("ÉTÉ", "été")]
        )
        self.bare = self._bare(vocabulary) if self.plain else None
        self.hasher = Hasher(31)
        #: ids of other words and of plain ones
        self.known: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        marks = self._each([chr(m) for m in MARKS])
        #: Number of a byte among the marks, 0 for others; only marks of one id count.
        self.mark = np.zeros(256, np.int64)
        apart = [one(f"the{chr(m)}") == one("the") + one(chr(m)) for m in MARKS]
        self.mark_ids = [END] + [int(np.frombuffer(x, "<u4")[0]) if len(x) == 4 and ok else -1 for x, ok in zip(marks, apart, strict=True)]
        for k, m in enumerate(MARKS, 1):
            self.mark[m] = k if self.mark_ids[k] >= 0 else 0

    def forget(self) -> None:
        for known in self.known:
            known.clear()

    def _each(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bare(self, vocabulary: str) -> Tokenizer | None:
        """The model behind a splitter at blanks, for lower-case words whose bytes are spelled as the vocabulary does.

        It skips the patterns of the whole tokenizer.  None if some probe differs.
        """
        from tokenizers import Tokenizer

        parts = json.loads(vocabulary) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        try:
            bare = Tokenizer.from_str(json.dumps(parts))
        except Exception:  # a model that does not stand alone
            return None
        probes = [*map(chr, (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))), "the", "straße", "éàçñ", "thereandthen"]
        for probe in probes:
            if bare.encode(self._spelled(probe.encode()), add_special_tokens=False).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                return None
        return bare

    @staticmethod
    def _spelled(words: bytes) -> str:
        text = words.decode("latin-1")
        return text if text.isascii() else text.translate(SPELLING)

    def _many(self, words: list[bytes], step: int = 100) -> list[bytes]:
        """Ids of plain words, many in one call."""
        out: list[bytes] = []
        tokenizer, spell = (self.bare, self._spelled) if self.bare else (self.tokenizer, bytes.decode)
        texts = [spell(b" ".join(words[k : k + step])) for k in range(0, len(words), step)]
        for k, e in enumerate(tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []):
            part = words[k * step : (k + 1) * step]
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(part):
                data, stops = ids.tobytes(), ends.tolist()
                out += [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            else:  # a vocabulary without such tokens
                out += self._each([w.decode() for w in part])
        return out

    def ids_of(self, words: list[bytes], plain: bool) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        known = self.known[plain]
        if len(known) > KNOWN:
            known.clear()
        out = list(map(known.get, words))
        fresh = [i for i, x in enumerate(out) if x is None]
        new = [words[i] for i in fresh]
        for i, w, x in zip(fresh, new, self._many(new) if plain else self._each([w.decode() for w in new]), strict=True):
            out[i] = known[w] = x
        return out

    def encode(self, text: pa.Array) -> Iterator[np.ndarray]:
        """32-bit ids of each text, the end id included."""
        if not self.by_word:
            for x in text:
                yield np.append(np.frombuffer(self._each([x.as_py() or ""])[0], "<u4"), np.array([END], "<u4"))
            return
        for lo, hi, data, bounds in pieces(text, ENCODED):
            starts, ends, first = find_words(data, bounds)
            letter, lower = _plain_bytes(data)
            strange = np.zeros(len(data) + 1, np.int32)
            np.cumsum(~letter, out=strange[1:])
            mark = np.where(ends - starts > 1, self.mark[data[ends - 1]] if len(ends) else 0, 0)
            stops = ends - (mark > 0)
            plain = (strange[stops] == strange[starts]) & self.plain
            mark, stops = np.where(plain, mark, 0), np.where(plain, stops, ends)
            # a plain word by its lower-case letters, any other by all its bytes
            hashes = self.hasher.words(lower, starts, stops)
            rest = np.flatnonzero(~plain)
            hashes[rest] = ~self.hasher.words(data, starts[rest], stops[rest])
            _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            other = index[inverse]
            same = np.where(plain, equal_words(lower, starts, stops, other), equal_words(data, starts, stops, other)) & (plain == plain[other])
            lone = np.flatnonzero(~same)  # words that only share a hash go by themselves
            inverse[lone] = len(index) + np.arange(len(lone))
            index = np.concatenate([index, lone])
            # other words first, then plain ones
            order = np.argsort(plain[index], kind="stable")
            cut = len(index) - int(plain[index].sum())
            place = np.empty(len(index), np.int64)
            place[order] = np.arange(len(index))
            index, inverse = index[order], place[inverse]
            found = []
            for part, content, kind in ((index[:cut], data, False), (index[cut:], lower, True)):
                raw = content.tobytes()
                found += self.ids_of([raw[a:b] for a, b in zip(starts[part].tolist(), stops[part].tolist(), strict=True)], kind)
            flat = np.frombuffer(b"".join(found) + np.array(self.mark_ids, "<i4").tobytes(), "<u4")
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            # two stretches of ids for each word, its own and its mark's
            n, at = np.empty(2 * len(starts), np.int64), np.empty(2 * len(starts), np.int64)
            n[0::2], n[1::2] = size[inverse], mark > 0
            at[0::2], at[1::2] = (np.cumsum(size) - size)[inverse], len(flat) - len(self.mark_ids) + mark
            total = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
            cuts = total[2 * first].tolist()
            for k in range(hi - lo):
                out = np.empty(cuts[k + 1] - cuts[k] + 1, "<u4")
                out[:-1], out[-1] = ids[cuts[k] : cuts[k + 1]], END
                yield out


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder; loading the vocabulary takes longer than a small task."""
    return Encoder(vocabulary)


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(vocabulary)
    try:
        yield from _cut(batches, coder, capacity)
    finally:
        coder.forget()  # the worker goes on to other tasks


def _cut(batches: Iterator[pa.RecordBatch], coder: Encoder, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(coder.encode(batch.column(1))):
            for k in range(0, len(ids), capacity):
                own = ids[k : k + capacity]
                rows.append(i)
                piece.append(k // capacity)
                start.append(k)
                length.append(len(own))
                crc.append(zlib.crc32(own))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                *[pa.array(x, pa.int64()) for x in (start, length, crc)],
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def best_fit(lengths: np.ndarray, limits: tuple[int, int, int], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; limits of tokens, documents and attention cost."""
    cap = np.array(limits, float)
    weights = np.array(WEIGHTS)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest = float(lengths.min()) if len(lengths) else 0.0
    spare = (smallest, 1.0, smallest * smallest)  # a bin with less room can take no piece any more
    # residuals of the bins that can, as columns, and their numbers
    left, number, live, opened = np.empty((3, max(1, len(lengths)))), np.empty(max(1, len(lengths)), np.int64), 0, 0
    for at in np.argsort(-lengths, kind="stable"):
        size = float(lengths[at])
        need = np.array([size, 1.0, size * size])
        if (need > cap).any():
            raise ValueError(f"a piece of {int(size)} tokens is above the limits {limits}")
        room = left[:, :live]
        fits = np.flatnonzero((room[0] >= need[0]) & (room[1] >= 1.0) & (room[2] >= need[2]))
        if len(fits):
            own = room[:, fits]
            if rule == "norm":
                score = weights @ ((own - need[:, None]) / cap[:, None]) ** 2
            else:
                score = -(weights * need / cap**2) @ own
            k = int(fits[np.argmin(score)])
        else:
            k = live
            left[:, k], number[k] = cap, opened
            live, opened = live + 1, opened + 1
        bins[at], offsets[at] = number[k], int(cap[0] - left[0, k])
        left[:, k] -= need
        if left[0, k] < spare[0] or left[1, k] < spare[1] or left[2, k] < spare[2]:
            live -= 1
            left[:, k], number[k] = left[:, live], number[live]
    return bins, offsets


def _pack(table: pa.Table, limits: tuple[int, int, int], rule: str, step: int) -> pa.Table:
    lengths = table.column("length").to_numpy()
    bins, offsets = best_fit(lengths, limits, rule)
    group = table.column("group")[0].as_py()
    table = table.drop_columns(["group"])
    table = table.append_column("sequence_id", pa.array(bins * step + group, pa.int64()))
    return table.append_column("offset", pa.array(offsets, pa.int64()))


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_cost: int | None = None,
    rule: str = "norm",
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` is the path of a ``tokenizers`` file on the driver.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    with open(vocabulary, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    limits = (capacity, max_documents or capacity, max_cost or capacity * capacity)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    scratch = Scratch(spark, "packing")
    made = df.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(lambda it: _pieces(it, sent.value, capacity), schema)
    pieces = scratch.keep(made, "pieces")
    whole = (F.col("length") == capacity) & F.lit(capacity * capacity <= limits[2])
    part = pieces.filter(~whole)
    groups = max(1, -(-part.count() // GROUP))
    dealt = part.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    out = f"{schema}, sequence_id long, offset long"
    packed = dealt.groupBy("group").applyInArrow(lambda t: _pack(t, limits, rule, groups), out)
    # numbers below zero are free for the sequences of one full piece
    alone = pieces.filter(whole).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(alone)
