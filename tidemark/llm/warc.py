"""Web archives: pages as legacy ARC files, a converter from ARC to WARC that writes repeated payloads once, and readers of both.

An archive holds records one behind the other, each a gzip member of its own (plain archives are read too). Spark writes
archives by its text writer: a member ends in a zero byte, the highest of its length, so members are the lines of a text
whose separator is the zero byte, and commits, retries and file systems are Spark's own. An archive holds about
``archive_bytes`` and at least a record; it is the only thing that a task reads whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from hashlib import sha1

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cut, shared_dir, texts_as_bytes

#: The fields of a record's header line in the two versions of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
LEVEL = 3
BATCH_BYTES = 4 << 20


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte; behind one of 16 MiB and more an empty one is put, so that it does too."""
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = coder.compress(data) + coder.flush()
    return out if out[-1] == 0 else out + member(b"")


def inflated(content: bytes | memoryview, piece: int = 1 << 14) -> Iterator[bytes]:
    """The bytes of an archive: all members of a gzip file one behind the other, or the content itself."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    coder, begun = zlib.decompressobj(31), False
    for at in range(0, len(content), piece):
        data = bytes(content[at : at + piece])
        while data:
            begun = True
            out = coder.decompress(data)
            if out:
                yield out
            data = b""
            if coder.eof:
                data, coder, begun = coder.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("an archive ends within a member")


class Source:
    """Lines and declared lengths out of pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.offset = pieces, b"", 0, 0

    def _more(self) -> bool:
        for piece in self.pieces:
            self.held, self.at = self.held[self.at :] + piece, 0
            return True
        return False

    def line(self) -> bytes | None:
        """The next line without its end; none behind the last."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                end = len(self.held)
                break
        if end == self.at == len(self.held):
            return None
        out = self.held[self.at : end]
        self.offset += min(end + 1, len(self.held)) - self.at
        self.at = min(end + 1, len(self.held))
        return out[:-1] if out.endswith(b"\r") else out

    def take(self, n: int) -> bytes:
        """The next n bytes; raises where there are fewer."""
        parts, left = [], n
        while left > len(self.held) - self.at:
            parts.append(self.held[self.at :])
            left -= len(parts[-1])
            self.held, self.at = b"", 0
            if not self._more():
                raise ValueError(f"a record declares {n} bytes and has {n - left}")
        parts.append(self.held[self.at : self.at + left])
        self.at += left
        self.offset += n
        return b"".join(parts)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP response; another block is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.compile(rb"\r?\n\r?\n").search(block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def warc_date(stamp: str) -> str:
    """A timestamp of 4 to 14 digits as a WARC date, missing parts the earliest; the first second of 1970 where it is none."""
    digits = stamp[:14]
    if not digits.isdigit() or len(digits) < 4:
        return NO_DATE
    digits += "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return NO_DATE


def digest_of(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Record:
    """One record of an ARC file, with the identifier, date and digest that its WARC record gets."""

    record_id: str
    kind: str
    url: str
    ip: str
    date: str
    mime: str
    head: bytes
    payload: bytes

    @property
    def page_id(self) -> int | None:
        """The page that the record was made of, if its response head says so."""
        found = re.search(rb"(?mi)^X-Page-ID: (-?\d+)\r?$", self.head)
        return int(found[1]) if found else None

    @property
    def digest(self) -> str:
        return digest_of(self.payload)


def arc_records(content: bytes | memoryview) -> Iterator[Record]:
    """Records of an ARC file. Its first record says which version it has and which fields a header line holds.

    A header line is read from its end, since addresses may hold spaces; the last field declares the length. Line ends
    between records may be more than one or missing. Raises where a length is wrong.
    """
    source = Source(inflated(content))
    first = source.line()
    if first is None:
        return
    if not first.startswith(b"filedesc:"):
        raise ValueError("not an ARC file")
    name = first.split(b" ")[0].decode("utf-8", "replace")
    block = source.take(int(first.rsplit(b" ", 1)[-1])).splitlines()
    version = int(block[0].split()[0])
    fields = block[1].decode().split() if len(block) > 1 and block[1].strip() else ARC_FIELDS[version].split()
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        at = source.offset
        values = dict(zip(fields, line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1), strict=True))
        head, payload = split_http(source.take(int(values["Archive-length"])))
        url, stamp = values["URL"], values.get("Archive-date", "")
        http = bool(head)
        kind = "response" if http or url.startswith("dns:") else "resource"
        unique = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {at} {url} {stamp}")
        yield Record(f"<urn:uuid:{unique}>", kind, url, values.get("IP-address", "-"), warc_date(stamp), values.get("Content-type", "-"), head, payload)


def warc_bytes(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _common(record_id: str, kind: str, url: str, ip: str, date: str, digest: str, payload_bytes: int) -> list[tuple[str, object]]:
    address = [("WARC-IP-Address", ip)] if ip not in ("-", "", "0.0.0.0") else []
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", url), *address]
    return [*named, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", payload_bytes)]


def response_bytes(r: Record) -> bytes:
    block = r.head + r.payload
    mime = "application/http; msgtype=response" if r.head else r.mime if r.mime not in ("-", "") else "application/octet-stream"
    fields = _common(r.record_id, r.kind, r.url, r.ip, r.date, r.digest, len(r.payload))
    return warc_bytes([*fields, ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", mime)], block)


def warcinfo_bytes(name: str) -> bytes:
    unique = uuid.uuid5(uuid.NAMESPACE_URL, name)
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{unique}>"), ("WARC-Date", NO_DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_bytes(fields, b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n")


def warc_records(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file; a field that goes on in a next line is joined."""
    source = Source(inflated(content))
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {source.offset}")
        fields: dict[str, str] = {}
        last = ""
        while (line := source.line()) is not None and line:
            text = line.decode("utf-8", "replace")
            if text[0] in " \t":
                fields[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                last = last.strip().lower()
                fields[last] = value.strip()
        yield fields, source.take(int(fields["content-length"]))


def packed(items: Iterator, prefix: str, opening: Callable[[str, int], bytes], made: Callable[[object, int], bytes], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """(archive, at, value): items dealt to archives, each begun by an opening record. ``opening`` gets an archive's name and number in
    the task, ``made`` an item and that number; an archive is full once the members that ``made`` gave it come to ``archive_bytes``."""
    task, number, at, held, out, waiting = TaskContext.get().partitionId(), -1, 0, archive_bytes, [], 0

    def flush() -> pa.RecordBatch:
        return batch(archive=[r[0] for r in out], at=[r[1] for r in out], value=pa.array([r[2] for r in out], pa.binary()))

    for item in items:
        if held >= archive_bytes:
            number, at, held = number + 1, 0, 0
            name = f"{prefix}-{task:06d}-{number:06d}"
            out.append((name, 0, member(opening(name, number))[:-1]))
        value = made(item, number)
        held += len(value)
        at += 1
        waiting += len(value)
        out.append((name, at, value[:-1]))
        if waiting > BATCH_BYTES:
            yield flush()
            out, waiting = [], 0
    if out:
        yield flush()


def write_archives(rows: DataFrame, path: str) -> None:
    """Write ``packed`` rows: an archive a folder, its records in order. Rows aren't shuffled, only ordered where they lie."""
    ordered = rows.sortWithinPartitions("archive", "at")
    ordered.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all archives below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


PACKED = "archive string, at bigint, value binary"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", crawled: str = "20240101000000", versions: tuple[int, ...] = (1, 2), archive_bytes: int = 16 << 20) -> None:
    """Write pages as ARC files, a record each: an HTTP response with the html's UTF-8 bytes, its head naming the page.

    Archives of a task take turns in ``versions`` of the format. A null html is an empty payload, a null id is left out
    of the head, a null or empty address is about:blank; white space and control characters in an address are escaped.
    Other columns aren't read; repeated rows are a record each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def version(number: int) -> int:
            return versions[(task + number) % len(versions)]

        def opening(name: str, number: int) -> bytes:
            body = f"{version(number)} 0 Pages\n{ARC_FIELDS[version(number)]}\n\n".encode()
            rest = "" if version(number) == 1 else f" 200 - - 0 {name}.arc"
            return f"filedesc://{name}.arc 0.0.0.0 {crawled} text/plain{rest} {len(body)}\n".encode() + body

        def made(item: tuple[int | None, str | None, bytes | None], number: int) -> bytes:
            page, url, html = item[0], item[1] or "", item[2] or b""
            named = f"X-Page-ID: {page}\r\n" if page is not None else ""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{named}Content-Length: {len(html)}\r\n\r\n".encode()
            address = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url) or "about:blank"
            rest = "" if version(number) == 1 else " 200 - - 0 -"
            return member(f"{address} 0.0.0.0 {crawled} text/html{rest} {len(head) + len(html)}\n".encode() + head + html + b"\n")

        items = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_as_bytes(b.column(2)), strict=True))
        yield from packed(items, "pages", opening, made, archive_bytes)

    chosen = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    write_archives(chosen.mapInArrow(run, PACKED), path)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """What is known of each ARC record but its payload: record_id, kind, url, ip, date, head, page_id, payload_bytes, digest and
    a second digest, so that two payloads count as equal only if SHA-1, a 128-bit hash and length agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                rows = []
                for r in arc_records(memoryview(content.as_buffer())):
                    rows.append((r.record_id, r.kind, r.url, r.ip, r.date, r.head, r.page_id, len(r.payload), r.digest, xxhash.xxh3_128_digest(r.payload)))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["record_id", "kind", "url", "ip", "date", "head", "page_id", "payload_bytes", "digest", "second"]
    types = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return archives(spark, path).mapInArrow(run, "record_id string, kind string, url string, ip string, date string, head binary, page_id bigint, payload_bytes bigint, digest string, second binary")


def revisits(index: DataFrame, least_bytes: int = 0, often: int = 100_000) -> DataFrame:
    """Records of ``index`` whose payload another record holds, with that record: of equal payloads of ``least_bytes`` and more, the one
    of the largest page (no page is the smallest; ties to the largest identifier).

    Payloads in more than one of ``often`` records, fewer than ``often`` of them, are joined by broadcast, all others by a shuffle.
    """
    keys = ["digest", "second", "payload_bytes"]
    whole = index.where(F.col("payload_bytes") >= least_bytes)
    held = F.max(F.struct("page_id", "record_id", "url", "date")).alias("held")
    groups = cut(whole.groupBy(*keys).agg(F.count("*").alias("n"), held).where("n > 1"))
    limit = max(1000, index.count() // often)
    many = F.broadcast(groups.where(F.col("n") > limit).select(*keys, "held"))
    few = groups.where(F.col("n") <= limit).select(*keys, "held")
    found = whole.join(many, keys).unionByName(whole.join(many, keys, "left_anti").join(few, keys))
    return found.where("record_id <> held.record_id")


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, archive_bytes: int = 16 << 20) -> None:
    """Convert all ARC files below ``arc`` into WARC files below ``warc``: responses with their payload, revisits without.

    The files are read twice: once for what is known of each payload, once to write it. Only records shuffle that are
    written, compressed, and not even those where the revisits are few.
    """
    again = cut(revisits(cut(arc_index(spark, arc)), least_bytes))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                ids, members, size = [], [], 0
                for r in arc_records(memoryview(content.as_buffer())):
                    ids.append(r.record_id)
                    members.append(member(response_bytes(r)))
                    size += len(members[-1])
                    if size > BATCH_BYTES:
                        yield batch(record_id=ids, value=pa.array(members, pa.binary()))
                        ids, members, size = [], [], 0
                if ids:
                    yield batch(record_id=ids, value=pa.array(members, pa.binary()))

    def revisit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = []
            for r in b.to_pylist():
                to = r["held"]
                fields = _common(r["record_id"], "revisit", r["url"], r["ip"], r["date"], r["digest"], r["payload_bytes"])
                fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to["record_id"]), ("WARC-Refers-To-Target-URI", to["url"]), ("WARC-Refers-To-Date", to["date"])]
                fields += [("X-Refers-To-Page-ID", to["page_id"])] if to["page_id"] is not None else []
                members.append(member(warc_bytes([*fields, ("Content-Type", "application/http; msgtype=response")], r["head"])))
            yield batch(value=pa.array(members, pa.binary()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (v.as_py() for b in batches for v in b.column(0))
        yield from packed(members, "warc", lambda name, _: warcinfo_bytes(f"{name}.warc.gz"), lambda value, _: value, archive_bytes)

    first = archives(spark, arc).mapInArrow(convert, "record_id string, value binary").join(again.select("record_id"), "record_id", "left_anti").select("value")
    write_archives(first.unionByName(again.mapInArrow(revisit, "value binary")).mapInArrow(pack, PACKED), warc)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all WARC files below a path but warcinfo: record_id, record_type, page_id, url, date, payload_bytes, payload_digest
    (base32 SHA-1), refers_to_record, refers_to (the page that it names) and, if asked for, the payload (null for a revisit).

    The digest and length of every payload that is there are computed again, and must be those declared.
    """
    names = ["record_id", "record_type", "page_id", "url", "date", "payload_bytes", "payload_digest", "refers_to_record", "refers_to", *["payload"] * payload]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, head = fields["warc-type"], b""
        content = block
        if fields.get("content-type", "").startswith("application/http"):
            head, content = split_http(block)
        page = re.search(rb"(?mi)^X-Page-ID: (-?\d+)\r?$", head)
        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("x-payload-length")
        if kind != "revisit":
            if digest != digest_of(content) or int(size or len(content)) != len(content):
                raise ValueError(f"payload of {fields['warc-record-id']} isn't what its header declares")
            size = len(content)
        to = fields.get("x-refers-to-page-id")
        known = (fields["warc-record-id"], kind, int(page[1]) if page else None, fields.get("warc-target-uri"), fields.get("warc-date"))
        rest = (None if size is None else int(size), digest, fields.get("warc-refers-to"), None if to is None else int(to))
        return (*known, *rest, content if kind != "revisit" else None)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

        for b in batches:
            for content in b.column(1):
                rows, size = [], 0
                for fields, block in warc_records(memoryview(content.as_buffer())):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    rows.append(row(fields, block))
                    size += 500 + len(block) * payload
                    if size > BATCH_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    schema = "record_id string, record_type string, page_id bigint, url string, date string, payload_bytes bigint, payload_digest string, refers_to_record string, refers_to bigint"
    return archives(spark, path).mapInArrow(run, schema + (", payload binary" if payload else ""))


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **options) -> DataFrame:
    """Pages written as ARC, converted to WARC below ``path`` (a folder in the shared one, unless given) and read back: ``read_warc``.

    A row a page; an empty table gives none. Of rows that repeat a payload one is the response, also where they repeat a page.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{path}/arc", **options)
    arc_to_warc(spark, f"{path}/arc", f"{path}/warc", least_bytes)
    return read_warc(spark, f"{path}/warc")
