from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest

from gapline.llm import warc


def brute(rows):
    best, out = {}, []
    for k, _, html in rows:
        body = (html or "").encode()
        best[body] = max(best.get(body, (False, 0)), (k is not None, k or 0))
    for k, _, html in rows:
        body = (html or "").encode()
        response = len(body) < 1000 or best[body] == (k is not None, k or 0)
        out.append((k, len(body), hashlib.sha1(body).hexdigest(), "response" if response else "revisit", None if response else best[body][1]))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(1)
    bodies = ["", None, "x" * 999, "x" * 1000, "é" * 500, "WARC/1.1\r\n\r\n" * 200, "HTTP/1.1 200 OK\r\n\r\nhttp://a 0 0 0 9\n" * 40, "\r\n\n" * 600]
    rows = [(k, f"http://h/{k} ü\n", rng.choice(bodies)) for k in range(200)] + [(None, None, "y" * 2000), (900, "", "y" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc.archive_round_trip(df, "page_id", "url", "html").collect()
    key = lambda r: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
    assert sorted(map(key, got), key=repr) == brute(rows)


def test_urls_of_any_form(spark):
    urls = ["ftp://h/a", "HTTP://h/a", " http://h/a", "/relative", "h/a b", "HTTPS://h", "mailto:x@y", "", None, "http://h/"]
    rows = [(k, u, body) for k, (u, body) in enumerate((u, b) for u in urls for b in ("x" * 1500, "short"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(df, "page_id", "url", "html").collect()
    key = lambda r: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
    assert sorted(map(key, got), key=repr) == brute(rows)


def test_repeated_rows_have_one_response(spark):
    df = spark.createDataFrame([(7, "http://a/", "z" * 1500, "k")] * 3, "page_id long, url string, html string, key string")
    got = sorted((r.record_type, r.refers_to) for r in warc.archive_round_trip(df, "page_id", "url", "html").collect())
    assert got[0] == ("response", None) and got[1:] == [("revisit", 7)] * 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df, "page_id", "url", "html").count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_version_specific_headers(version):
    body = warc.http_response(b"hello\nhttp://x 1 2 3 4\n", "9")
    data = warc.version_block("a.arc", version, "20050102030405") + b"\n" + warc.arc_record("http://u/ v", version, "20050102", body, 0, "a.arc") + b"\n"
    for content in (data, gzip.compress(data), gzip.compress(data[:40]) + gzip.compress(data[40:])):
        first, second = warc.read_arc(content, "a.arc")
        assert (first["kind"], first["date"]) == ("warcinfo", "2005-01-02T03:04:05Z")
        assert (second["kind"], second["url"], second["date"], second["block"]) == ("response", "http://u/ v", "2005-01-02T00:00:00Z", body)
        assert second["id"] == list(warc.read_arc(content, "a.arc"))[1]["id"] != first["id"]


def test_damaged_archives_keep_what_stands_before():
    data = warc.version_block("a.arc", 1, "20050102030405") + b"\n" + warc.arc_record("http://u/", 1, "20050102030405", b"abc", 0, "a.arc")
    assert [r["kind"] for r in warc.read_arc(data + b"\nhttp://v 0.0.0.0 2005 text/html 99\nshort", "a.arc")] == ["warcinfo", "resource", "damaged"]
    assert [r["kind"] for r in warc.read_arc(data + b"\nno header", "a.arc")] == ["warcinfo", "resource", "damaged"]
    assert [r["kind"] for r in warc.read_arc(b"junk 3\nabc", "a.arc")] == ["damaged"]


def test_warc_fields():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    record = warc.warc_record("response", {"WARC-Record-ID": "<urn:uuid:1>", "X": None}, block) + b"\r\n\r\n"
    ((headers, got),) = warc.read_warc(record)
    assert headers["warc-type"] == "response" and headers["content-length"] == str(len(block)) and got == block


def test_records_are_gzip_members_and_ids_the_same_in_each_run(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"body {k} " * 50) for k in range(60)] + [(100, "http://long", "long " * 600_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    ids = []
    for run in ("a", "b"):
        warc.write_arc(df, f"file://{tmp_path}/{run}-arc", "page_id", "url", "html")
        warc.convert_arc(spark, f"file://{tmp_path}/{run}-arc", f"file://{tmp_path}/{run}-warc")
        ids.append(sorted(r.id for r in warc.warc_records(spark, f"file://{tmp_path}/{run}-warc").collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 62
    (path,) = (tmp_path / "a-arc").glob("part-000000.arc.gz")
    assert path.read_bytes().startswith(b"\x1f\x8b")
    for path in (tmp_path / "a-warc").glob("part-*.warc.gz"):
        data, records = path.read_bytes(), 0
        while data:
            unpack = zlib.decompressobj(31)
            record = unpack.decompress(data)
            data = unpack.unused_data
            assert record == b"" or record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            records += record != b""
        assert records
