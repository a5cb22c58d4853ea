"""Conversion of legacy ARC archives to WARC, and readers of both.

An ARC file begins with a version block: a ``filedesc://`` record whose body has
the version number and, on its second line, the names of the fields of every
record header in the file (five in version 1, ten in version 2).  A record is a
header line of these fields and as many bytes as its last field declares.  The
reader takes the fields by their names in the file's own definition and the
payload by the declared length, so payloads may hold any bytes and lines that
look like headers.

The converter makes for each record an equivalent WARC record: an identifier
that is a name-based UUID of the archive, the offset and the header line (the
same in each run), the date as ISO 8601, the type (the version block becomes
``warcinfo``, HTTP responses ``response``, others ``resource``) and SHA-1 digests
of block and payload.  The archive is known by the name in its version block.  Of records with equal payloads of at least ``REVISIT``
bytes that with the largest key stays a response; the others become ``revisit``
records, which keep the HTTP header and refer to it.

Archives are written by Spark's text writer, one file for a partition.  Every
record is a gzip member of its own, so readers can start at any; the writer's line
separator is an empty member.  They are read as binary files, so any store that
Spark reads will do; a file is one row, of 2 GB at most, and is unpacked as it is
read.  A damaged record (a header that does not parse, a length beyond the file)
ends its file's records: what stands before it is kept, and a row of type
``damaged`` with the offset follows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.store import Scratch, rename_parts
from gapline.llm.textkernel import bound_arrow_batches, tidy

REVISIT = 1000
#: The header fields of the two versions, and WARC's profile of equal payloads.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: names that are URLs
KEY_HEADER = "X-Archive-Key"
END = b"\r\n"
#: Unpacks to nothing.
EMPTY = gzip.compress(b"", 1, mtime=0)


def plain_url(url: str | None) -> str:
    """The URL without blanks and control characters, which a header line cannot hold."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-"


def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 gapline\n{FIELDS[version]}\n\n".encode()
    middle = "0.0.0.0" if version == 1 else f"0.0.0.0 {date} text/plain 200 - - 0 {name}"
    head = f"filedesc://{name} {middle}" + (f" {date} text/plain" if version == 1 else "")
    return f"{head} {len(body)}\n".encode() + body


def arc_record(url: str, version: int, date: str, body: bytes, offset: int, name: str) -> bytes:
    if version == 1:
        head = f"{url} 0.0.0.0 {date} text/html {len(body)}"
    else:
        head = f"{url} 0.0.0.0 {date} text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}"
    return head.encode() + b"\n" + body


def http_response(payload: bytes, key: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY_HEADER}: {key}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def member(record: bytes) -> bytes:
    return gzip.compress(record, 1, mtime=0)


@tidy
def _write_arc(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    version, name = 1 + part % 2, f"part-{part:06d}.arc"
    line = version_block(name, version, date)
    offset = len(line)
    yield pa.RecordBatch.from_arrays([pa.array([member(line)], pa.binary())], names=["line"])
    for batch in batches:
        lines = []
        for key, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = http_response((payload or "").encode(), "" if key is None else str(key))
            record = arc_record(plain_url(url), version, date, body, offset, name) + b"\n"
            lines.append(member(record))
            offset += len(record)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])


def write_arc(df: DataFrame, path: str, key_col: str, url_col: str, payload_col: str, date: str = "20240101000000") -> None:
    """Write rows as ARC archives, odd partitions in version 2 and even ones in version 1."""
    lines = df.select(key_col, url_col, payload_col).mapInArrow(lambda it: _write_arc(it, date), "line binary")
    _write_members(lines, path, "arc.gz")


def _write_members(lines: DataFrame, path: str, kind: str) -> None:
    """Files ``part-<number>.<kind>`` of gzip members."""
    writer = lines.select(F.col("line").cast("string")).write.mode("overwrite")
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)
    rename_parts(lines.sparkSession, path, kind)


class Stream:
    """Bytes of a gzipped or plain archive, unpacked as they are read."""

    def __init__(self, content: bytes | pa.Buffer, step: int = 1 << 20):
        self.content, self.step, self.at = memoryview(content).cast("B"), step, 0
        self.gzip = self.content[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31)
        self.held, self.place = bytearray(), 0  # what is unpacked and not yet read; offset of its start

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at : self.at + self.step]
        self.at += len(part)
        if not self.gzip:
            self.held += part
            return True
        while len(part):
            self.held += self.unpack.decompress(part)
            part = self.unpack.unused_data
            if self.unpack.eof:  # the next member
                self.unpack = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        look = 0
        while (k := self.held.find(b"\n", look)) < 0:
            look = len(self.held)
            if not self._more():
                return self.take(len(self.held)) if self.held else None
        return self.take(k + 1)[:-1]

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.place += len(out)
        return out


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, body); a block that is no HTTP response is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head + gap, body) if gap else (b"", block)


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def iso_date(date: str) -> str:
    """A 14-digit date (shorter ones are filled up) as ISO 8601."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_arc(content: bytes | pa.Buffer, name: str) -> Iterator[dict]:
    """The records of an ARC archive, the version block first; the archive's name stands in it."""
    stream, fields = Stream(content), None
    while True:
        offset = stream.place
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        damaged = {"offset": offset, "kind": "damaged", "url": line[:200].decode("utf-8", "replace"), "date": "", "block": b"", "id": ""}
        parts = line.decode("utf-8", "replace").split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            yield damaged
            return
        block = stream.take(length)
        if length < 0 or len(block) < length:
            yield damaged
            return
        if fields is None:
            definition = block.split(b"\n")
            if not parts[0].startswith("filedesc://") or len(definition) < 2 or not definition[0][:1].isdigit():
                yield damaged
                return
            fields = definition[1].decode().split(" ")
            kind, date = "warcinfo", next((p for p in parts[1:] if len(p) == 14 and p.isdigit()), "")
            url = parts[0]
            name = url.removeprefix("filedesc://")
        else:
            extra = len(parts) - len(fields)
            if extra < 0:
                yield damaged
                return
            values = dict(zip(fields, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
            url, date = values.get("URL", ""), values.get("Archive-date", "")
            kind = "response" if block.startswith(b"HTTP/") else "resource"  # whatever the URL's scheme
        made = uuid.uuid5(NAMESPACE, f"{name}/{offset}/{line.decode('utf-8', 'replace')}")
        yield {"offset": offset, "kind": kind, "url": url, "date": iso_date(date), "block": block, "id": f"urn:uuid:{made}"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return b"WARC/1.1" + END + END.join(x.encode() for x in lines) + END + END + block


def read_warc(content: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records; names of headers are lower case."""
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {"warc-type": "damaged"}, line
            return
        headers: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            key, _, value = line.partition(b":")
            headers[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        length = int(headers.get("content-length", "0"))
        block = stream.take(length)
        if len(block) < length:
            yield {"warc-type": "damaged"}, block
            return
        yield headers, block


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


ARC_ROWS = "id string, archive string, offset long, kind string, url string, date string, key string, size long, sha1 string"


@tidy
def _arc_rows(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ARC_ROWS.split(", ")] + (["packed"] if payloads else [])
    types = [pa.int64() if x.endswith("long") else pa.string() for x in ARC_ROWS.split(", ")] + [pa.binary()] * payloads
    squeeze = zstandard.ZstdCompressor(level=3)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            name, rows, held = path.rsplit("/", 1)[-1], [], 0
            for r in read_arc(content.as_buffer(), name):
                head, body = split_http(r["block"])
                rows.append(
                    (r["id"], name, r["offset"], r["kind"], r["url"], r["date"], header_value(head, KEY_HEADER), len(body), hashlib.sha1(body).hexdigest())
                )
                if payloads:
                    rows[-1] += (squeeze.compress(r["block"]),)
                    held += len(rows[-1][-1])
                if len(rows) >= 2000 or held > 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def arc_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path``; ``packed`` has the block, compressed."""
    bound_arrow_batches(spark)
    schema = ARC_ROWS + (", packed binary" if payloads else "")
    return _files(spark, path).mapInArrow(lambda it: _arc_rows(it, payloads), schema)


@tidy
def _write_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        lines, held = [], 0
        for i in range(batch.num_rows):
            r = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
            block = unpack.decompress(r["packed"]) if r["packed"] else b""
            head, body = split_http(block)
            headers = {"WARC-Record-ID": f"<{r['id']}>", "WARC-Date": r["date"] or None}
            kind = r["kind"]
            if kind == "warcinfo":
                fields = f"software: gapline\r\nformat: WARC File Format 1.1\r\nisPartOf: {r['url']}\r\n".encode()
                lines.append(warc_record(kind, headers | {"Content-Type": "application/warc-fields"}, fields))
            else:
                content = "application/http; msgtype=response" if head else "text/html"
                headers |= {"WARC-Target-URI": r["url"], "Content-Type": content, "WARC-Payload-Digest": digest(body)}
                if r["target"] is not None:
                    kind, block = "revisit", head
                    headers |= {
                        "WARC-Profile": PROFILE,
                        "WARC-Refers-To": f"<{r['target']}>",
                        "WARC-Refers-To-Target-URI": r["target_url"],
                        "WARC-Refers-To-Date": r["target_date"],
                        f"WARC-Refers-To-{KEY_HEADER}": r["target_key"],
                    }
                lines.append(warc_record(kind, headers | {"WARC-Block-Digest": digest(block)}, block))
            lines[-1] = member(lines[-1] + END + END)
            held += len(lines[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])
                lines, held = [], 0
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the records of the ARC archives under ``arc_path`` as WARC archives.

    Equal payloads are found from digests alone; the decisions, a row for each
    record that becomes a revisit, then meet the records by identifier and file,
    which are unique, so no group of equal payloads lands in one task.
    """
    scratch = Scratch(spark, "archives")
    rows = scratch.keep(arc_records(spark, arc_path).filter(f"kind = 'response' and size >= {REVISIT}"), "digests")
    key = F.coalesce(F.expr("try_cast(key as bigint)"), F.lit(-(1 << 63)))
    best = F.max(F.struct(key.alias("k"), "id", "archive", "url", "date", "key"))
    first = rows.groupBy("sha1", "size").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = scratch.keep(first.select("sha1", "size", "best"), "first")
    revisits = rows.join(first, ["sha1", "size"]).filter(
        (F.col("id") != F.col("best.id")) | (F.col("archive") != F.col("best.archive"))
    )
    revisits = scratch.keep(
        revisits.select(
            "id",
            "archive",
            F.col("best.id").alias("target"),
            F.col("best.url").alias("target_url"),
            F.col("best.date").alias("target_date"),
            F.col("best.key").alias("target_key"),
        ),
        "revisits",
    )
    records = arc_records(spark, arc_path, payloads=True).filter("kind <> 'damaged'")
    lines = records.join(revisits, ["id", "archive"], "left").mapInArrow(_write_warc, "line binary")
    _write_members(lines, warc_path, "warc.gz")
    scratch.drop("digests", "first", "revisits")


WARC_ROWS = "kind string, id string, url string, key string, size long, sha1 string, refers_to string, refers_key string, date string"


@tidy
def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in WARC_ROWS.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in WARC_ROWS.split(", ")]
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for h, block in read_warc(content.as_buffer()):
                head, body = split_http(block)
                given = h.get("warc-payload-digest", "")
                if h["warc-type"] == "revisit":
                    size = int(header_value(head, "Content-Length") or 0)
                    sha1 = base64.b32decode(given.removeprefix("sha1:")).hex()
                else:
                    size, sha1 = len(body), hashlib.sha1(body).hexdigest()
                kind = h["warc-type"] if not given or given == digest(body) or h["warc-type"] == "revisit" else "damaged"
                target = f"warc-refers-to-{KEY_HEADER.lower()}"
                rows.append(
                    (kind, h.get("warc-record-id"), h.get("warc-target-uri"), header_value(head, KEY_HEADER), size, sha1,
                     h.get("warc-refers-to"), h.get(target), h.get("warc-date"))
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
                )


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC archives under ``path``."""
    bound_arrow_batches(spark)
    return _files(spark, path).mapInArrow(_warc_rows, WARC_ROWS)


def archive_round_trip(df: DataFrame, key_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Archive the rows as ARC, convert the archives to WARC and read those back.

    A row for each row of ``df``: key, payload_bytes, payload_digest, record_type,
    refers_to.  A null payload is empty; a null key is the smallest.  Of repeated
    rows one is the response.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    scratch = Scratch(spark, "warc")
    write_arc(df, scratch.path("arc"), key_col, url_col, payload_col)
    convert_arc(spark, scratch.path("arc"), scratch.path("warc"))
    scratch.drop("arc")
    rows = warc_records(spark, scratch.path("warc")).filter("kind <> 'warcinfo'")
    return rows.select(
        F.expr("try_cast(key as bigint)").alias(key_col),
        F.col("size").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.expr("try_cast(refers_key as bigint)").alias("refers_to"),
    )
