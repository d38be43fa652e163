"""Legacy ARC archives to WARC, and back to rows.

An ARC file opens with a version block (``filedesc://``) that names the field
list of its header lines: version 1 has URL, IP, date, type and length, version
2 puts result code, checksum, location, offset and file name before the length.
:func:`parse_arc` reads both by the declared lengths; a further version block
inside a file switches the version.  :func:`convert` synthesises for each record a
WARC one: a name-based UUID, an ISO date from the 14-digit one, target URI, type
(``response``, or ``revisit`` of the smallest key with the same payload) and
SHA-256 block and payload digests.

Archives are text files whose line separator is the record separator, written
by Spark's own committer, so they go wherever Spark can write; each row is a block
of records of about ``BLOCK_BYTES`` and a file holds ``BLOCKS_PER_FILE``.

Defined results: null html is an empty payload; a null url an empty one; null
page ids stay null and never stand for others.  Payloads under ``min_bytes`` are
responses.  Rows that share the smallest page id are all responses.  Pages are
never cut.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import table
from clickcast.session import scratch_path

MIN_REVISIT_BYTES = 100
BLOCK_BYTES = 4 << 20
BLOCKS_PER_FILE = 4
MAX_BROADCAST_DIGESTS = 100_000
DATE = b"20240101000000"
#: Field lists of the two versions.
FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_SCHEMA = ("page_id long, url string, ip string, date string, mime string, payload_bytes long, "
                 "payload_digest string, block binary")
HEAD_END = b"\r\n\r\n"


def _blocks(records: Iterator[bytes], opening: bytes, between: bytes) -> Iterator[bytes]:
    """Joins records into blocks, each led by ``opening``."""
    part, size = [opening], 0
    for r in records:
        part.append(r)
        size += len(r)
        if size >= BLOCK_BYTES:
            yield between.join(part)
            part, size = [opening], 0
    if len(part) > 1:
        yield between.join(part)


def _write(blocks: DataFrame, path: str, separator: str) -> None:
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", separator).option(
        "compression", "gzip").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def _read(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- ARC ---------------------------------------------------------------------


def arc_version_block(version: bytes) -> bytes:
    body = version + b" 0 pages\n" + FIELDS[version] + b"\n"
    head = b"filedesc://pages.arc 0.0.0.0 " + DATE + b" text/plain "
    extra = b"200 - - 0 pages.arc " if version == b"2" else b""
    return head + extra + str(len(body)).encode() + b"\n" + body


def arc_record(version: bytes, page_id: int | None, url: str | None, html: str | None) -> bytes:
    """Header line and an HTTP response holding the html."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    key = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    body = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + key
            + b"Content-Length: %d" % len(payload) + HEAD_END + payload)
    safe = re.sub(rb"[\x00-\x20%]", lambda m: b"%%%02X" % m[0][0], (url or "").encode("utf-8", "surrogatepass")) or b"-"
    extra = b"200 - - 0 pages.arc " if version == b"2" else b""
    return safe + b" 0.0.0.0 " + DATE + b" text/html " + extra + str(len(body)).encode() + b"\n" + body


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC archives of (page_id, url, html); blocks take the versions in turn."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, batch in enumerate(batches):
            version = b"12"[k % 2:k % 2 + 1]
            rows = ((None if pd.isna(i) else int(i), u, h) for i, u, h in zip(batch["page_id"], batch["url"], batch["html"]))
            for block in _blocks((arc_record(version, *r) for r in rows), arc_version_block(version), b"\n"):
                yield pd.DataFrame({"block": [block]})

    _write(pages.select("page_id", "url", "html").mapInPandas(run, "block binary"), path, "\n")


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, str, bytes]]:
    """(url, ip, date, mime, body) of each record; version blocks are read and left out."""
    at, n_fields = 0, 5
    while at < len(data):
        if data[at:at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end] if end >= 0 else data[at:]
        opening = line.startswith(b"filedesc://")
        fields = line.rsplit(b" ", 4 if opening else n_fields - 1)
        if len(fields) < 5 or not fields[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        start, size = end + 1, int(fields[-1])
        body = data[start:start + size]
        if len(body) < size:
            raise ValueError(f"ARC record cut short: {line[:200]!r}")
        if opening:
            names = body.split(b"\n")[1].split(b" ")
            n_fields = len(names)
        else:
            url, ip, date, mime = (f.decode("utf-8", "replace") for f in fields[:4])
            url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) <= 32 or m[1] == "25"
                         else m[0], url)
            yield ("" if url == "-" else url), ip, date, mime, body
        at = start + size


def read_arc(spark, path: str) -> DataFrame:
    """One row per record; ``block`` is the record's body."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for url, ip, date, mime, body in parse_arc(_plain(content)):
                    payload, key, _ = _http(body)
                    rows.append((key, url, ip, date, mime, len(payload), hashlib.sha256(payload).hexdigest(), body))
                yield _frame(rows, ["page_id", "url", "ip", "date", "mime", "payload_bytes", "payload_digest", "block"])
    return _read(spark, path).mapInPandas(run, RECORD_SCHEMA)


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        if c in columns:
            out[c] = out[c].astype("Int64")
    return out


def _http(body: bytes) -> tuple[bytes, int | None, int | None]:
    """(payload, page id, declared payload length) of an HTTP response; other bodies are payload."""
    if not body.startswith(b"HTTP/"):
        return body, None, None
    head, _, payload = body.partition(HEAD_END)
    key = re.search(rb"(?m)^X-Page-Id: (-?\d+)\r?$", head)
    size = re.search(rb"(?m)^Content-Length: (\d+)\r?$", head)
    return payload, int(key[1]) if key else None, int(size[1]) if size else None


# --- WARC --------------------------------------------------------------------


def warc_date(date: str) -> str:
    """ISO form of a 14-digit (or shorter) ARC date."""
    d = re.sub(r"\D", "", date).ljust(4, "0")[:14]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


def warc_record(row, refers_to) -> bytes:
    """A response record, or a revisit of ``refers_to`` that keeps only the HTTP header."""
    block = bytes(row.block)
    http = block.startswith(b"HTTP/")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(row.url, row.date, row.payload_digest, row.page_id)),
        ("WARC-Date", warc_date(row.date)),
        ("WARC-Target-URI", row.url),
        ("WARC-IP-Address", row.ip),
        ("WARC-Payload-Digest", f"sha256:{row.payload_digest}"),
        ("Content-Type", "application/http; msgtype=response" if http else row.mime),
    ]
    if refers_to is not None:
        block = block[:block.find(HEAD_END) + 4] if http else b""
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {re.sub('[\x00-\x1f]', ' ', v)}\r\n" for k, v in head)
    return b"WARC/1.0\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block


def convert(spark, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """WARC archives of all records of the ARC archives under ``arc_path``."""
    records = read_arc(spark, arc_path)
    firsts = records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    firsts = firsts.persist()
    try:
        if firsts.count() <= MAX_BROADCAST_DIGESTS:
            firsts = F.broadcast(firsts)
        joined = records.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(
            F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")))
        opening = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: " + warc_date(DATE.decode()).encode() + (
            b"\r\nWARC-Record-ID: <urn:uuid:%s>\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n"
            % str(uuid.uuid5(uuid.NAMESPACE_URL, "warcinfo")).encode())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = (warc_record(r, None if pd.isna(r.refers_to) else int(r.refers_to))
                        for r in batch.astype({"page_id": "Int64"}).itertuples())
                for block in _blocks(rows, opening, HEAD_END):
                    yield pd.DataFrame({"block": [block]})

        _write(joined.mapInPandas(run, "block binary"), warc_path, "\r\n\r\n")
    finally:
        firsts.unpersist()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(HEAD_END, at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {data[at:at + 100]!r}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        if start + size > len(data):
            raise ValueError(f"WARC record cut short: {head.get('WARC-Record-ID')}")
        yield head, data[start:start + size]
        at = start + size


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url); digests are verified."""
    def row(head: dict[str, str], block: bytes):
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"block digest differs: {head['WARC-Record-ID']}")
        payload, key, declared = _http(block)
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest differs: {head['WARC-Record-ID']}")
        refers = int(head["X-Refers-To-Page-Id"]) if kind == "revisit" else None
        return (key, declared if kind == "revisit" else len(payload), digest, kind, refers,
                head["WARC-Record-ID"], head["WARC-Target-URI"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield _frame([row(h, b) for h, b in parse_warc(_plain(content)) if h["WARC-Type"] != "warcinfo"], [
                    "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"])

    return _read(spark, path).mapInPandas(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "record_id string, url string")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


@register("op4_warc", SQL)
def op4_warc(spark, sf_dir: str) -> DataFrame:
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
