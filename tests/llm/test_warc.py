"""Archives: the query against its SQL and a direct computation, the converter on archives written by hand, and odd pages."""

import glob
import gzip
import os
from base64 import b32encode
from hashlib import sha1

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_queries import rows

from tidemark.llm import queries
from tidemark.llm import warc as W

BIG = "0123456789abcdef" * (1 << 16)


def expected(pages, least=0):
    held = {}
    for page, _, html in pages:
        key = html or ""
        held[key] = max(held.get(key, (-1, None)), (-1 if page is None else page, page))
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        first = len(data) < least or held[html or ""][1] == page
        out.append((page, len(data), b32encode(sha1(data).digest()).decode(), "response" if first else "revisit", None if first else held[html or ""][1]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def pages_of(spark, rows_):
    return spark.createDataFrame(rows_, "page_id long, url string, html string")


def test_query_matches_its_sql(spark):
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(queries.op13_warc(spark, DATA).toPandas()) == rows(duck.execute(queries.ORACLES["op13_warc"]).df())


def test_odd_pages(spark):
    odd = [
        (1, "http://a/", "<p>x</p>"), (2, "http://b/ c\nd\te", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "http://e", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
        (6, "http://f", "HTTP/1.1 200 OK\r\nX-Page-ID: 77\r\n\r\nbody"), (7, "http://g", "\x00\x1f\x8b é 日本 😀\r\n\n"), (8, "http://h", BIG + "a"), (9, "http://h", BIG + "a"), (None, "http://n", "<p>x</p>"),
        (10, "http://ü", "\n\n\n"), (11, "http://k 1 2 3", "<p>y</p>" * 10), (12, "http://l", "z" * (17 << 20)),
    ]
    for options in ({}, {"versions": (2,), "archive_bytes": 300}, {"versions": (1,), "archive_bytes": 1}, {"least_bytes": 9}):
        found = W.archived(pages_of(spark, odd).repartition(3), **options)
        assert got(found) == expected(odd, options.get("least_bytes", 0))


def test_groups_of_many_copies_are_joined_by_broadcast(spark):
    many = [(i, f"http://p/{i}", ["<p>hot</p>", f"<p>{i // 2}</p>"][i % 4 == 0 or i % 7 == 0]) for i in range(3000)]
    found = W.archived(pages_of(spark, many).repartition(4))
    assert got(found) == expected(many)


def test_a_revisit_names_a_response_that_is_there(spark, tmp_path):
    many = [(i, f"http://p/{i}", f"<p>{i % 5}</p>") for i in range(40)]
    found = {r.record_id: r for r in W.archived(pages_of(spark, many), path=str(tmp_path)).collect()}
    assert len(found) == 40
    for r in found.values():
        if r.record_type == "revisit":
            to = found[r.refers_to_record]
            assert (to.record_type, to.page_id, to.payload_digest) == ("response", r.refers_to, r.payload_digest)
    again = W.read_warc(spark, f"{tmp_path}/warc", payload=True).where("record_type = 'response'").collect()
    assert {r.page_id: r.payload.decode() for r in again} == {i: f"<p>{i % 5}</p>" for i in range(35, 40)}


def test_files_are_archives_that_other_tools_can_read(spark, tmp_path):
    W.archived(pages_of(spark, [(i, f"http://p/{i}", f"<p>{i}</p>") for i in range(20)]).coalesce(1), path=str(tmp_path))
    (arc,), (warc,) = (glob.glob(f"{tmp_path}/{kind}/archive=*/part-*") for kind in ("arc", "warc"))
    lines = gzip.open(arc).read().split(b"\n")
    assert lines[0].startswith(b"filedesc://pages-000000-000000.arc 0.0.0.0 20240101000000 text/plain ") and lines[1] == b"1 0 Pages"
    assert lines[2].decode() == W.ARC_FIELDS[1]
    content = open(warc, "rb").read()
    assert content.count(b"\x1f\x8b\x08") >= 21 and gzip.decompress(content).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert [f["warc-type"] for f, _ in W.warc_records(content)] == ["warcinfo"] + ["response"] * 20


V1 = b"filedesc://old.arc 0.0.0.0 19980203040506 text/plain 76\n1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
V2 = (
    b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc 122\n2 0 Somebody\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n\n"
)


def opened(version):
    body = version.split(b"\n", 1)[1].rstrip(b"\n") + b"\n"
    return version.split(b"\n", 1)[0].rsplit(b" ", 1)[0] + f" {len(body)}\n".encode() + body + b"\n"


def test_archives_written_by_hand(tmp_path):
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>1</p>"
    bare = b"HTTP/1.0 404 Not Found\n\ngone"
    one = opened(V1) + b"http://a/b c d 10.0.0.1 19980203 text/html %d\n%s\n" % (len(page), page) + b"dns:a 1.2.3.4 1998 text/dns 7\na A 1.2\n\n\nhttp://e - 0 no-type 3\nabc"
    two = opened(V2) + b"http://f 10.0.0.2 20010203040599 text/html 404 - - 122 new.arc %d\n%s\n" % (len(bare), bare)
    first, second, third = W.arc_records(one)
    assert (first.url, first.ip, first.date, first.mime, first.kind, first.payload) == ("http://a/b c d", "10.0.0.1", "1998-02-03T00:00:00Z", "text/html", "response", b"<p>1</p>")
    assert (second.kind, second.date, second.payload, second.head) == ("response", "1998-01-01T00:00:00Z", b"a A 1.2", b"")
    assert (third.kind, third.date, third.payload, third.page_id) == ("resource", W.NO_DATE, b"abc", None)
    (only,) = W.arc_records(two)
    assert (only.url, only.head, only.payload, only.date) == ("http://f", b"HTTP/1.0 404 Not Found\n\n", b"gone", W.NO_DATE)
    members = b"".join(gzip.compress(x) for x in (opened(V1), one[len(opened(V1)) :]))
    assert [r.record_id for r in W.arc_records(members)] == [first.record_id, second.record_id, third.record_id]
    for broken in (one[:-1], members[:-9], b"http://a 1 2 3 4\n"):
        with pytest.raises(ValueError):
            list(W.arc_records(broken))


def test_foreign_archives_are_converted(spark, tmp_path):
    page = b"HTTP/1.0 200 OK\r\n\r\nsame"
    record = b"http://%s 10.0.0.1 20010203040506 text/html %d\n%s\n"
    os.makedirs(tmp_path / "arc")
    for name in (b"a", b"b"):
        (tmp_path / "arc" / f"{name.decode()}.arc.gz").write_bytes(gzip.compress(opened(V1.replace(b"old", name)) + record % (name, len(page), page)))
    W.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = sorted(W.read_warc(spark, str(tmp_path / "warc")).collect(), key=lambda r: r.record_type)
    assert [r.record_type for r in found] == ["response", "revisit"] and found[1].refers_to_record == found[0].record_id
    assert {(r.url, r.date, r.payload_bytes, r.page_id) for r in found} == {("http://a", "2001-02-03T04:05:06Z", 4, None), ("http://b", "2001-02-03T04:05:06Z", 4, None)}


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    same = pages_of(spark, [(1, "u", "x"), (1, "u", "x"), (1, "u", "x"), (2, "v", "y")]).withColumn("digest", F.lit(1)).withColumn("held", F.lit(2)).withColumn("record_id", F.lit(3))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in W.archived(same).collect() if r.record_type == "response") == [(1, "response", None), (2, "response", None)]
    assert [r.refers_to for r in W.archived(same).where("record_type = 'revisit'").collect()] == [1, 1]
    assert W.archived(same.limit(0)).collect() == []
