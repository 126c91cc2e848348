"""Legacy archive converter: ARC files of either version become WARC files with equal contents.

ARC: the first record, `filedesc://`, names the version and the fields of each record's header line; a record is that
line, as many bytes as its last field declares, and a line feed. WARC records get identifiers (from archive name and
offset), ISO timestamps (from the 14 or 12 digits of the archive date), types (warcinfo, response for HTTP messages,
resource for the rest) and SHA-1 digests of block and payload. Of records with equal payloads of at least
REVISIT_BYTES the one with the largest key stays a response; the others become revisits that refer to it.

Archives are rows of at most ARCHIVE_BYTES before compression (one longer record has an archive of its own); Spark's
text writer puts each in a gzip file of the shared folder and its binaryFile reader brings it back, so no path is
opened by Python. Only digests, keys and identifiers are grouped by payload; what each archive's revisits refer to meets
the archive, as it is stored, by its name, so equal payloads never meet in a task.

Header lines that fit no version are skipped up to the next one that does. Contents shorter than declared are kept and
marked `WARC-Truncated: length`. Nulls: a null html is an empty payload, a null url is `-`, a null page_id writes no key
and reads back as null. Repeated rows are records of their own; of equal keys one is the response. An empty table
gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 1000
KEY_HEADER = "X-Page-Id"

#: Fixed values of the ARC format: names of the fields of a header line by version, and the description of a file.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Fixed value of the WARC format: the profile of a revisit by digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "archive string, offset long, url string, ip string, date string, mime string, record_type string, key long, record_id string, truncated boolean, payload_digest string, payload_bytes long"


# ---------------------------------------------------------------- archives as rows


def archives_of(parts: Iterator[bytes], head: bytes, most: int = ARCHIVE_BYTES) -> Iterator[pa.RecordBatch]:
    """Joins records to archives that begin with head."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > most:
            yield _one(head, held)
            held, size = [], 0
        held.append(part)
        size += len(part)
    if held:
        yield _one(head, held)


def _one(head: bytes, held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"value": pa.array([head + b"".join(held)], pa.binary())})


def write_archives(archives: DataFrame, path: str) -> str:
    """One gzip file for each row. The text writer passes bytes on as they are; an archive may end with a line feed.

    Most of the time goes into compression, so its fastest level is taken."""
    fast = archives.select(F.col("value").cast("string")).write.option("zlib.compress.level", "BEST_SPEED")
    fast.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def unpacked(content: bytes) -> bytes:
    """Contents of a file of one or more gzip members, or as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(content))
        content = z.unused_data
    return b"".join(out)


# ---------------------------------------------------------------- ARC


def arc_head(version: int, date: str) -> bytes:
    block = f"{version} 0 notelake\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    line = f"filedesc://pages.arc 0.0.0.0 {date} text/plain" + (" 200 - - 0 pages.arc" if version == 2 else "")
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes) -> bytes:
    more = " 200 - - 0 pages.arc" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {len(content)}\n".encode() + content + b"\n"


_HEAD = re.compile(rb"(.*) (\S+) (\d{12,14}|-) (\S+)(?: (\S+) (\S+) (\S+) (\d+|-) (\S+))? (\d+)")


def _line(line: bytes, version: int | None):
    """The fields of a header line, by the version's count of them from the right: a url may hold blanks."""
    if version in (None, 1):
        m = re.fullmatch(rb"(.*) (\S+) (\d{12,14}|-) (\S+) (\d+)", line)
        if m and (version == 1 or not _HEAD.fullmatch(line)):
            return m[1], m[2], m[3], m[4], int(m[5])
    m = _HEAD.fullmatch(line)
    return (m[1], m[2], m[3], m[4], int(m[10])) if m and (m[5] is not None or version != 2) else None


def arc_records(content: bytes):
    """(offset, url, ip, date, mime, block, truncated) of each record, the file's description first."""
    data, at, version = unpacked(content), 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        first = line.startswith(b"filedesc:")
        fields = _line(line, None if first else version) if line else None
        if fields is None:
            at = end + 1
            continue
        url, ip, date, mime, length = fields
        block = data[end + 1 : end + 1 + length]
        if first and (m := re.match(rb"(\d+) ", block)):
            version = int(m[1]) if int(m[1]) in ARC_FIELDS else None
        yield at, url.decode("utf-8", "replace"), ip.decode("latin-1"), date.decode(), mime.decode("latin-1"), block, len(block) < length
        at = end + 1 + length


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head and body of an HTTP message; anything else is all body."""
    if block[:5] != b"HTTP/":
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def headers(head: bytes) -> dict[str, str]:
    """The values of a head's fields by their names in lower case, of repeated fields the first."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\n"):
        name, colon, value = line.partition("\r")[0].partition(":")
        if colon:
            out.setdefault(name.lower(), value.lstrip(" \t"))
    return out


def _key(stated: str | None) -> int | None:
    """A key as it was written: any whole number of 64 bits, else none."""
    if not stated or not re.fullmatch(r"-?\d{1,19}", stated):
        return None
    key = int(stated)
    return key if -(1 << 63) <= key < 1 << 63 else None


def iso(date: str) -> str:
    d = date.ljust(14, "0") if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{offset}"))


def record_type(url: str, head: bytes) -> str:
    return "warcinfo" if url.startswith("filedesc:") else "response" if head else "resource"


def _parsed(with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, url, ip, date, mime, block, short in arc_records(content.as_py()):
                    head, body = http_parts(block)
                    kind = record_type(url, head)
                    key = headers(head).get(KEY_HEADER.lower())
                    row = (archive, offset, url, ip, iso(date), mime, kind, _key(key))
                    row += (record_id(archive, offset), short, hashlib.sha1(body).hexdigest(), len(body))
                    rows.append((*row, block) if with_block else row)
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, with_block)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, with_block)

    return run


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in RECORDS.split(", ")] + ["block"]


def _batch(rows: list[tuple], with_block: bool) -> pa.RecordBatch:
    n = len(_NAMES) - (not with_block)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES[:n], strict=True)], names=_NAMES[:n])


def read_arc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The records of all ARC files at path."""
    return read_archives(spark, path).mapInArrow(_parsed(with_block), RECORDS + (", block binary" if with_block else ""))


# ---------------------------------------------------------------- WARC


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def warc_record(archive: str, record: tuple, target: dict | None) -> bytes:
    """One WARC/1.1 record of a record of arc_records; target: what it is a revisit of. A revisit keeps the HTTP head as its block."""
    offset, url, ip, date, mime, block, truncated = record
    head, body = http_parts(block)
    if target is not None:
        block = head
    kind = "revisit" if target is not None else record_type(url, head)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(archive, offset)}>", f"WARC-Date: {iso(date)}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {_digest(hashlib.sha1(body).digest())}"]
    if target is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{target['record_id']}>", f"WARC-Refers-To-Target-URI: {target['url']}", f"WARC-Refers-To-Date: {target['date']}", f"X-Payload-Length: {len(body)}"]
    if truncated:
        lines.append("WARC-Truncated: length")
    mime = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if head else mime
    lines += [f"WARC-Block-Digest: {_digest(hashlib.sha1(block).digest())}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            for archive, content, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                targets = {r["offset"]: r for r in revisits.as_py() or []}
                for record in arc_records(content.as_py()):
                    yield warc_record(archive, record, targets.get(record[0]))

    yield from archives_of(records(), b"")


def revisits(spark: SparkSession, arc_path: str) -> DataFrame:
    """For each archive with any, the offsets of records whose payload a record of a larger key has, and what these are."""
    seen = read_arc(spark, arc_path, with_block=False).where((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("record_type") == "response"))
    seen = written(seen.select("archive", "offset", "key", "record_id", "url", "date", F.unhex("payload_digest").alias("digest")), "arc-records")
    last = F.max(F.struct("key", "record_id", "url", "date")).alias("last")
    repeated = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), last).where("n > 1").select("digest", "last")
    linked = seen.select("archive", "offset", "record_id", "digest").join(repeated, "digest").where(F.col("last.record_id") != F.col("record_id"))
    target = F.struct("offset", F.col("last.record_id").alias("record_id"), F.col("last.url").alias("url"), F.col("last.date").alias("date"))
    return linked.groupBy("archive").agg(F.collect_list(target).alias("revisits"))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> str:
    """Writes WARC archives with the records of the ARC archives; each file's description becomes a warcinfo record."""
    found = read_archives(spark, arc_path).join(revisits(spark, arc_path), "archive", "left").select("archive", "content", "revisits")
    return write_archives(found.mapInArrow(_to_warc, "value binary"), warc_path)


def warc_records(content: bytes):
    """(header fields, record block) of each record, by declared lengths."""
    data, at = unpacked(content), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        head = data[at:cut]
        fields = headers(head)
        length = int(fields.get("content-length") or 0)
        yield fields, data[cut + 4 : cut + 4 + length]
        at = cut + 4 + length


READ = "key long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_id string"


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain = lambda x: x[x.rfind(":") + 1 :].strip("<> ") if x else None
    for batch in batches:
        for content in batch.column(0):
            out = []
            for fields, block in warc_records(content.as_py()):
                kind = fields.get("warc-type")
                if kind == "warcinfo":
                    continue
                http, body = http_parts(block)
                said = headers(http)
                stated = fields.get("warc-payload-digest")
                sha1 = base64.b32decode(stated[5:]).hex() if stated else None
                size = len(body)
                if kind == "revisit":
                    size = int(fields.get("x-payload-length") or said.get("content-length") or 0)
                elif sha1 != hashlib.sha1(body).hexdigest():
                    raise ValueError(f"payload of {fields.get('warc-record-id')} does not fit its digest")
                out.append((_key(said.get(KEY_HEADER.lower())), plain(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), size, sha1, plain(fields.get("warc-refers-to"))))
            if out:
                names = [x.split()[0] for x in READ.split(", ")]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the response, resource and revisit records at path say; payloads are held against their digests."""
    return read_archives(spark, path).select("content").mapInArrow(_back, READ)


# ---------------------------------------------------------------- the query


def pages_to_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000") -> str:
    """Writes pages (page_id, url, html) as legacy archives; each content is an HTTP response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    body = (html.as_py() or "").encode()
                    key = "" if page is None else f"{KEY_HEADER}: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(body)}\r\n\r\n"
                    yield arc_record(version, re.sub(r"[\r\n]+", " ", url or "-"), "0.0.0.0", date, "text/html", head.encode() + body)

        yield from archives_of(records(), arc_head(version, date))

    return write_archives(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary"), path)


def op10_legacy_archive_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through legacy archives to WARC archives, and what these say when they are read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arc = pages_to_arc(pages, new_path(spark, "arc"))
    warc = convert(spark, arc, new_path(spark, "warc"))
    back = written(read_warc(spark, warc), "warc-read")
    target = back.where("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("key").alias("refers_to"))
    linked = back.join(target, back.refers_to_id == target.target_id, "left")
    return linked.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.last > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last > p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
