"""3. WARC archives: writing, and a splittable reader.

Writing: each record is its own gzip member. Of records with equal payloads of at least `min_revisit` bytes the one of the
largest id is a response and the others are revisits that refer to it. A task writes one file under a name of its own
attempt and returns that name with the file's size; only names in the written listing are read, so a task that runs twice
leaves an unread file behind and nothing else.

Reading: the listing gives byte ranges of `split_bytes`. The task of a range scans its bytes for gzip magic, accepts a
candidate if the member decodes to the start of a WARC record, and owns every record whose member starts inside
the range; it reads past the range's end until its last record is whole. Splits hold the same records at every split size.

Null html is an empty payload; a null url is written as the empty target. Null and repeated ids keep one record
for each row; among equal payloads of equal ids the order is that of the rows' targets, then one of them is taken.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, salted_join, saved

MIN_REVISIT = 1000
SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
#: Bytes of a candidate that are decoded to see whether a record starts there.
PROBE = 64
DATE = "2000-01-01T00:00:00Z"


def _open_fs(path: str):
    """File system and path in it; paths come qualified by the session's file system (common.shared_dir)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record(row_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload; its lengths and digest are those of the full payload."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{row_id}|{url}|{digest}'.encode()).digest()[:16])}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if row_id is None else row_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files in folder; returns the listing (path, bytes, records)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # the listing of repeated payloads: small rows, combined before the shuffle
    twice = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = salted_join(rows, twice, ["digest"], "left", F.xxhash64("page_id"))

    def run(batches):
        fs, where = _open_fs(folder)
        fs.create_dir(where, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        out = None
        seen: set[str] = set()  # payloads whose response a row of equal id has already become, in this file
        for b in batches:
            for i, url, text, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first_id"))):
                out = out or fs.open_output_stream(f"{where}/{name}", compression=None)
                revisit = first is not None and (i != first or digest in seen)
                if first is not None and not revisit:
                    seen.add(digest)
                data = _member(record(i, url, text.encode(), digest, first, revisit))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return saved(marked.mapInArrow(run, "path string, bytes long, records long"), "warc-listing")


def _head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_in(f, start: int, end: int, size: int):
    """(offset, header, block) of each record whose member starts in [start, end) of the open file f of that size."""
    buf, base = b"", start
    at = start

    def fill(upto: int) -> None:
        """Makes buf reach `upto`, or the file's end."""
        nonlocal buf
        upto = min(upto, size)
        while base + len(buf) < upto:
            f.seek(base + len(buf))
            got = f.read(max(READ, upto - base - len(buf)))
            if not got:
                break
            buf += got

    while at < end:
        if at - base > READ:
            buf, base = buf[at - base :], at
        fill(at + READ)
        hit = buf.find(MAGIC, at - base)
        if hit < 0:
            at = max(at, base + len(buf) - len(MAGIC) + 1)
            if base + len(buf) >= size:
                return
            continue
        at = base + hit
        if at >= end:
            return
        fill(at + 4096)
        try:
            if not zlib.decompressobj(31).decompress(buf[at - base :], PROBE).startswith(b"WARC/1."):
                raise zlib.error
            d, parts, pos = zlib.decompressobj(31), [], at
            while not d.eof:
                fill(pos + READ)
                chunk = buf[pos - base : pos - base + READ]
                if not chunk:
                    raise zlib.error
                parts.append(d.decompress(chunk))
                pos += len(chunk) - len(d.unused_data)
            data = b"".join(parts)
            head, _, body = data.partition(b"\r\n\r\n")
            fields = _head(head)
            n = int(fields["content-length"])
            if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
                raise zlib.error
        except (zlib.error, KeyError, ValueError):
            at += 1  # magic inside compressed data
            continue
        yield at, fields, body[:n]
        at = pos


def read_archives(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the listed files: path, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and the payload (null for revisits). A response whose payload does not match its digest raises."""
    ranges = listing.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition("path", "start")

    def run(batches):
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                fs, where = _open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(where) as f:
                    for at, h, body in records_in(f, start, min(start + split_bytes, size), size):
                        revisit = h["warc-type"] == "revisit"
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(h["x-payload-length"])):
                            raise ValueError(f"{path} at {at}: payload does not match its digest")
                        rows.append((path, at, int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], h["warc-type"], int(h["x-refers-to-page-id"]) if h.get("x-refers-to-page-id") not in (None, "None") else None, int(h["x-payload-length"]), digest, None if revisit else body))
                        held += len(body)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return dealt.mapInArrow(run, "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _RECORD)], schema=_RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, reads the archives back and gives what each record says."""
    listing = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_archives(listing).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: what the contract says of each page.
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM m
"""
