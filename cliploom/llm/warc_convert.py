"""Legacy archive converter: ARC files of versions 1 and 2 become WARC files.

The version block of each ARC file says which header line its records have; the
declared length of a record, not its contents, says where it ends. The converter
synthesises what ARC lacks: record ids, ISO timestamps, record types, block and
payload digests. Records whose payload is equal to an earlier one's become
revisits, decided over the whole collection: digests are gathered, payloads stay
in their files. Only the decisions, grouped by file, meet the files again.

Spark reads and writes all files (binaryFile and text sources), so any store that
Spark knows will do. Archives are cut at ``file_bytes`` before compression.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh_path, materialize

FILE_BYTES, READ_BYTES, MIN_REVISIT_BYTES = 16 << 20, 1 << 14, 100
#: Every record is compressed twice, when archived and when converted; levels beyond 1 take twice as long for 6 % less.
GZIP_LEVEL = 1
#: Archive date of records that come without one.
NO_DATE = "20000101000000"
ORIGIN = "cliploom"
#: Field names of the header lines of both ARC versions.
V1_FIELDS = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2_FIELDS = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
FIELDS = {1: V1_FIELDS, 2: V2_FIELDS}
_blank_line = re.compile(rb"\r\n\r\n")
_unsafe = re.compile(r"[\x00-\x20\x7f-\xa0  ]")

#: Fields of an ARC header line that WARC has no name for go into headers of our own, if they say anything.
UNNAMED_FIELDS = ("Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename")
#: An empty gzip member: whatever stands before it, the file ends with a zero byte.
LAST_MEMBER = gzip.compress(b"", mtime=0)
META_SCHEMA = "archive string, name string, offset long, url string, date string, key long, digest string, payload_bytes long"
WARC_SCHEMA = "archive string, offset long, record_type string, record_id string, uri string, date string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long"


def _url(url: str | None) -> str:
    """A URL without white space or controls, as both header lines need it; null is about:blank."""
    return _unsafe.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "about:blank" if url else "about:blank"


def _arc_record(version: int, url: str, mime: str, body: bytes, date: str = NO_DATE, offset: int = 0, name: str = "-") -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def _arc_start(version: int, name: str) -> bytes:
    body = f"{version} 0 {ORIGIN}\n{' '.join(FIELDS[version])}\n".encode()
    return _arc_record(version, f"filedesc://{name}", "text/plain", body, name=name)


def _http(payload: bytes, key: int | None) -> bytes:
    """Response header; the key of the row travels in a header of its own."""
    own = f"X-Row-Key: {key}\r\n" if key is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()


def _member(record: bytes) -> bytes:
    return gzip.compress(record, GZIP_LEVEL, mtime=0)


def _file(members: list[bytes]) -> pa.RecordBatch:
    """A file's bytes but for the last one, which is zero and added as the line separator."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members) + LAST_MEMBER[:-1]], pa.binary())], ["value"])


def _write(files: DataFrame, path: str) -> str:
    """Each row's bytes as one file of gzip members. The text source ends each with its line separator, the last byte of the last member."""
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)
    return path


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> str:
    """Archive pages in ARC files under ``path``, a gzip member for each record; files of version 1 and 2 alternate.

    Null html is empty, a null or empty url is about:blank, a row without an id has
    no key. Repeated rows are records of their own; other columns are left out. No
    rows, no files. ``file_bytes`` counts before compression.
    """
    df = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.coalesce(F.encode(F.col(html_col), "utf-8"), F.lit(b"")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                version, name = 1 + (part + n) % 2, f"{ORIGIN}-{part:06d}-{n:05d}.arc"
                if not parts:
                    start = _arc_start(version, name)
                    parts, size = [_member(start)], len(start)
                payload = html.as_py()
                record = _arc_record(version, _url(url), "text/html", _http(payload, key) + payload, offset=size, name=name)
                parts.append(_member(record))
                size += len(record)
                if size >= file_bytes:
                    yield _file(parts)
                    parts, n = [], n + 1
        if parts:
            yield _file(parts)

    return _write(df.mapInArrow(run, "value binary"), path)


def _plain(content: bytes) -> bytes:
    """The contents, fed to each member's decoder in blocks, so that what follows a member isn't copied for it."""
    if content[:2] != b"\x1f\x8b":
        return content
    view, at, out = memoryview(content), 0, []
    while at < len(content) and content[at]:  # zero bytes may pad the end
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(content):
                raise EOFError("gzip member has no end")
            out.append(member.decompress(view[at : at + READ_BYTES]))
            at += READ_BYTES
        at = min(at, len(content)) - len(member.unused_data)
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[tuple[int, str, dict[str, str], memoryview]]:
    """(offset, archive name, header fields, body) of each record behind the version block, which tells the name.

    Raises ValueError where the version block, a header line or a declared length
    doesn't fit: what follows in such a file has no known boundaries.
    """
    at, version, name, fields, view = 0, 0, "", V1_FIELDS, memoryview(content)
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        if not values[-1].isdigit() or end < 0:
            raise ValueError(f"ARC header line at {at} declares no length: {line[:100]!r}")
        size, body = int(values[-1]), end + 1
        if body + size > len(content):
            raise ValueError(f"ARC record at {at} declares {size} bytes, {len(content) - body} are left")
        if values[0].startswith("filedesc:"):
            first, _, names = content[body : body + size].decode("utf-8", "replace").partition("\n")
            version = int(first.split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            fields, name = tuple(names.split("\n")[0].split(" ")) or FIELDS[version], values[0].removeprefix("filedesc://")
        else:
            if not version:
                raise ValueError("ARC file without a version block")
            if len(values) < len(fields):
                raise ValueError(f"ARC header line at {at} has {len(values)} fields of {len(fields)}")
            extra = len(values) - len(fields)  # some writers left spaces in URLs
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
            yield at, name, dict(zip(fields, values, strict=True)), view[body : body + size]
        at = body + size


def _split_http(body: memoryview) -> tuple[bytes, memoryview]:
    """HTTP header (empty if there is none) and payload."""
    if bytes(body[:5]) != b"HTTP/":
        return b"", body
    end = _blank_line.search(body)
    return (bytes(body[: end.end()]), body[end.end() :]) if end else (b"", body)


def _key(http: bytes) -> int | None:
    m = re.search(rb"(?im)^X-Row-Key: (-?\d+)\r?$", http)
    return int(m[1]) if m else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def _rows(columns: list[str], schema: pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    lists = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(lists, schema.types, strict=True)], columns)


def arc_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record with its payload's SHA-256 and size; payloads stay behind."""
    names = ["archive", "name", "offset", "url", "date", "key", "digest", "payload_bytes"]
    schema = pa.schema([(n, pa.int64() if n in ("offset", "key", "payload_bytes") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for offset, name, head, body in parse_arc(_plain(content.as_py())):
                    http, payload = _split_http(body)
                    out.append((archive, name, offset, head["URL"], head["Archive-date"], _key(http), hashlib.sha256(payload).hexdigest(), len(payload)))
                yield _rows(names, schema, out)

    return _files(spark, path).mapInArrow(run, META_SCHEMA)


def record_id(*said: object) -> str:
    """A record's URN, made from what its archive says (name, offset, URL, date, payload digest), not from where the archive lies: the same whenever it is made again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '#'.join(map(str, said)))}>"


def _arc_fields(head: dict[str, str]) -> list[tuple[str, str]]:
    """What the ARC header line says beyond URL, date and length."""
    ip = head.get("IP-address", "-")
    named = [("WARC-IP-Address", ip)] if ip not in ("-", "0.0.0.0") else []
    return named + [(f"X-ARC-{f}", head[f]) for f in UNNAMED_FIELDS if head.get(f, "-") not in ("-", "")]


def _iso(date: str) -> str:
    d = (re.sub(r"\D", "", date) + NO_DATE[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_record(kind: str, rid: str, uri: str | None, date: str, mime: str, block: bytes, more: Iterable[tuple[str, str]] = ()) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []), *more, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def revisits(meta: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """archive, offset and the record that each revisit refers to.

    Of records with equal payloads of at least ``min_bytes`` the one with the
    smallest key stays; ties go by archive and offset, records without a key last.
    """
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("archive"), F.col("offset"), F.col("name"), F.col("url"), F.col("date"))
    first = meta.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("digest", "first"), "firsts")
    pairs = meta.where(F.col("payload_bytes") >= min_bytes).join(first, "digest")
    own = (F.col("archive") == F.col("first.archive")) & (F.col("offset") == F.col("first.offset"))
    return pairs.where(~own).select("archive", "offset", F.struct("first.name", "first.offset", "first.key", "first.url", "first.date").alias("refers"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, file_bytes: int = FILE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write the WARC files that are equivalent to the ARC files under ``arc_path``, a gzip member for each record.

    Every record is converted, repeated ones too; those without a payload of
    ``min_bytes`` never become revisits. A broken archive raises ValueError. No
    archives, no files. All fields of the ARC header line are carried.
    """
    meta = materialize(arc_metadata(spark, arc_path), "arc")
    # An archive holds a bounded number of records, so its list of revisits is bounded.
    by_file = revisits(meta, min_bytes).groupBy("archive").agg(F.collect_list(F.struct("offset", "refers")).alias("decided"))
    files = _files(spark, arc_path).join(materialize(by_file, "revisits"), "archive", "left").select("content", "decided")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, decided in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                refers = {d["offset"]: d["refers"] for d in decided or []}
                parts, size = [], 0
                for offset, name, head, body in parse_arc(_plain(content.as_py())):
                    if not parts:
                        start = _warc_record("warcinfo", record_id(name), None, _iso(NO_DATE), "application/warc-fields", f"software: {ORIGIN}\r\nconversion-of: {name}\r\n".encode())
                        parts, size = [_member(start)], len(start)
                    http, payload = _split_http(body)
                    digest, url, date = hashlib.sha256(payload).hexdigest(), head["URL"], head["Archive-date"]
                    mime = "application/http;msgtype=response" if http else head["Content-type"]
                    kind, block, more = "response" if http else "resource", bytes(body), [("WARC-Payload-Digest", f"sha256:{digest}"), *_arc_fields(head)]
                    if (r := refers.get(offset)) is not None:
                        kind, block = "revisit", http
                        more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["name"], r["offset"], r["url"], r["date"], digest)), ("WARC-Refers-To-Target-URI", r["url"]), ("WARC-Refers-To-Date", _iso(r["date"]))]
                        more += [("X-Refers-To-Key", str(r["key"]))] if r["key"] is not None else []
                    more += [("X-Payload-Length", str(len(payload)))]
                    record = _warc_record(kind, record_id(name, offset, url, date, digest), url, _iso(date), mime, block, more)
                    parts.append(_member(record))
                    size += len(record)
                    if size >= file_bytes:
                        yield _file(parts)
                        parts = []
                if parts:
                    yield _file(parts)

    return _write(files.mapInArrow(run, "value binary"), warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, header fields by lower-case name, block) of each record."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, body = int(head["content-length"]), end + 4
        if body + size > len(content):
            raise ValueError(f"WARC record at {at} declares {size} bytes, {len(content) - body} are left")
        yield at, head, view[body : body + size]
        at = body + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files but for warcinfo, digests checked against the blocks.

    Records without our own headers have a null key and the payload's own length;
    equal records are rows of their own. A broken archive raises ValueError.
    """
    names = [c.split()[0] for c in WARC_SCHEMA.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in WARC_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for offset, head, block in parse_warc(_plain(content.as_py())):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, payload = _split_http(block)
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{archive}: payload at {offset} doesn't have its digest")
                    size = int(head.get("x-payload-length", len(payload)))
                    refers = head.get("x-refers-to-key")
                    out.append((archive, offset, head["warc-type"], head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"], _key(http), size, digest, head.get("warc-refers-to"), int(refers) if refers else None))
                yield _rows(names, schema, out)

    return _files(spark, path).mapInArrow(run, WARC_SCHEMA)


def op2_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC files and the converter to WARC files, and what reading those gives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arc = write_arc(pages, fresh_path(spark, "arc"))
    warc = convert(spark, arc, fresh_path(spark, "warc"))
    return read_warc(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
