"""BAM files as a Spark data source.

``read_bam`` takes files from any store that Spark reads; ``register`` makes
``spark.read.format("bam")`` available for files that every executor can open.
A file is one task's work, so ``write_bam`` makes many.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gapline.deploy import ship

SCHEMA = "tid int, rname string, qname string, flag int, pos int, mapq int, cigar string, seq string, qual string, nm int, nn int, score int, aln_id bigint"
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the compressed blocks."""
    at = 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        yield at, zlib.decompress(data[at + 18 : at + size - 8], -15)
        at += size


def _header(body: bytes) -> tuple[list[tuple[str, int]], int]:
    """(names and lengths of the references, offset of the first record)."""
    if body[:4] != b"BAM\1":
        raise ValueError("no BAM file")
    at = 8 + struct.unpack_from("<i", body, 4)[0]
    n = struct.unpack_from("<i", body, at)[0]
    at += 4
    out = []
    for _ in range(n):
        size = struct.unpack_from("<i", body, at)[0]
        out.append((body[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", body, at + 4 + size)[0]))
        at += 8 + size
    return out, at


_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _tags(data: bytes) -> dict[str, object]:
    at, out = 0, {}
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * _SIZES[sub]
        else:
            out[name] = chr(data[at]) if kind == "A" else struct.unpack_from(_CODES[kind], data, at)[0]
            at += _SIZES[kind]
    return out


def decode(record: bytes, refs: list[tuple[str, int]], ident: int) -> tuple:
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", record, 0)
    at = 32
    name = record[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", record, at))
    at += 4 * n_cigar
    packed = record[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    quals = record[at : at + l_seq]
    qual = "*" if quals[:1] in (b"", b"\xff") else "".join(chr(q + 33) for q in quals)
    tags = _tags(record[at + l_seq :])
    return (tid, refs[tid][0] if tid >= 0 else None, name, flag, pos, mapq, cigar, seq, qual, tags.get("NM"), tags.get("nn", 0), tags.get("AS"), ident)


def decode_records(data: bytes) -> Iterator[tuple]:
    """The records of a whole file, numbered by the offset of their block and their place in the file."""
    body = b"".join(content for _, content in blocks(data))
    refs, at = _header(body)
    while at + 4 <= len(body):
        size = struct.unpack_from("<i", body, at)[0]
        yield decode(body[at + 4 : at + 4 + size], refs, at)
        at += 4 + size


END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # fixed value: an empty block
_CIGAR = re.compile(r"([0-9]+)([MIDNSHP=X])")


def encode_header(refs: list[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs).encode()
    body = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, size in refs:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return body


def encode_record(r: dict) -> bytes:
    """A record with tid, qname, flag, pos, mapq, cigar (text or pairs of number and letter), seq and integer tags."""
    name = r["qname"].encode() + b"\0"
    seq = r["seq"]
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    pairs = [(int(n), op) for n, op in _CIGAR.findall(r["cigar"])] if isinstance(r["cigar"], str) else r["cigar"]
    cigar = b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in pairs)
    tags = b"".join(k.encode() + b"i" + struct.pack("<i", v) for k, v in r.get("tags", {}).items())
    core = struct.pack("<iiBBHHHiiii", r["tid"], r["pos"], len(name), r["mapq"], 0, len(pairs), r["flag"], len(seq), -1, -1, 0)
    record = core + name + cigar + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(record)) + record


def block(part: bytes) -> bytes:
    """A compressed block of at most 60,000 bytes or so."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = squeeze.compress(part) + squeeze.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(part), len(part))


def encode(refs: list[tuple[str, int]], records: list[dict]) -> bytes:
    """A whole BAM file."""
    body = encode_header(refs) + b"".join(map(encode_record, records))
    return b"".join(block(body[k : k + 60_000]) for k in range(0, len(body), 60_000)) + END_BLOCK


def write_bam(df: DataFrame, refs: list[tuple[str, int]], path: str, *, tags: tuple[str, ...] = ("nm",)) -> None:
    """Write alignments sorted by coordinate, a folder ``tid=<number>`` of BAM files for each chromosome.

    ``df`` has tid, qname, flag, pos, mapq, cigar, seq and the integer columns ``tags``.
    Ranges of coordinates are tasks, so a chromosome is as many files as it needs.  A
    file is a header block and blocks of records; Spark's text writer puts an empty
    block between any two, which readers skip.
    """
    ship(df.sparkSession)
    columns = ["tid", "qname", "flag", "pos", "mapq", "cigar", "seq", *tags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held = None, 0, b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["tid"] != here:
                    if held:
                        out.append((here, number, block(held)))
                    here, number, held = r["tid"], 1, b""
                    out.append((here, 0, block(encode_header(refs))))
                own = encode_record({**r, "seq": "" if r["seq"] in (None, "*") else r["seq"], "tags": {t.upper(): r[t] for t in tags if r[t] is not None}})
                if len(held) + len(own) > 60_000 and held:
                    out.append((here, number, block(held)))
                    number, held = number + 1, b""
                while len(own) > 60_000:
                    out.append((here, number, block(own[:60_000])))
                    number, own = number + 1, own[60_000:]
                held += own
            if out:
                yield _batch(out)
        if held:
            yield _batch([(here, number, block(held))])

    def _batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        tid, number, data = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(tid, pa.int32()), pa.array(number, pa.int32()), pa.array(data, pa.binary())], names=["tid", "number", "data"])

    rows = df.select(*columns).repartitionByRange("tid", "pos").sortWithinPartitions("tid", "pos", "qname")
    lines = rows.mapInArrow(run, "tid int, number int, data binary").sortWithinPartitions("tid", "number")
    writer = lines.select("tid", F.col("data").cast("string").alias("value")).write.mode("overwrite").partitionBy("tid")
    writer.option("encoding", "ISO-8859-1").option("lineSep", END_BLOCK.decode("latin-1")).text(path)


def read_chromosome(spark: SparkSession, path: str, tid: int) -> DataFrame:
    """The records of one chromosome of what ``write_bam`` wrote; no file of another is opened."""
    return read_bam(spark, f"{path}/tid={tid}")


def lookup(alignments: DataFrame, ids: DataFrame, *, key: str = "aln_id") -> DataFrame:
    """The alignments whose ids are listed."""
    return alignments.join(ids.select(key).distinct(), key, "left_semi")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path`` from any store that Spark reads; a file is one task's work."""

    ship(spark)

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in decode_records(content.as_buffer().to_pybytes()):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition):
        with open(partition.path, "rb") as file:
            yield from decode_records(file.read())


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)`` for files that every executor can open."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
