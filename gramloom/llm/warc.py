"""Operator 9, WARC: write archives and read them back sequentially.

**Write.**  Equal payloads of at least ``min_bytes`` bytes are kept once: the
smallest page id per payload digest is found by an aggregate over (digest,
id) alone, and only digests that occur more than once are joined back to the
pages, so page texts aren't shuffled while that table is small.  Each task
streams its pages into one ``.warc.gz`` file of the shared folder, one gzip
member per record.

**Read.**  :func:`records` decompresses a file piece by piece, member after
member, frames each record by its Content-Length and checks block and payload
digests; at most one record is in memory.  A cut-off file, a wrong length, or
a digest that doesn't fit raises ``ValueError``.

A task that is run again writes a file of another name; the stored manifest
names the one that counts.

Defined cases: null html is an empty payload; a null url gives no target
header; a page without id is a revisit if a page with an id has its payload,
else a response; rows that share the smallest id are all responses; an empty
table gives no file; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import scratch_path, ship_package, spread, stored, text_or_empty
from gramloom.llm.huffman import _open, _uri

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
READ_SIZE = 1 << 16
# Repeated digests up to this number are broadcast (some 60 bytes each); beyond it the join shuffles.
BROADCAST_DIGESTS = 200_000


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def page_record(page_id: int | None, url: str | None, html: str, refers_to: int | None, level: int = 6) -> bytes:
    """The response or revisit record of a page."""
    payload = html.encode()
    digest = sha1_32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)),
               ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%~")))
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)),
                    ("Refers-To-Page-ID", str(refers_to))]
    return member(headers, block, level)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers and body of the block."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("no end of the HTTP header")
        return _headers(head), body


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode().strip().lower()] = v.decode().strip()
    return out


def records(stream) -> Iterator[Record]:
    """The records of a ``.warc.gz`` stream, in order."""
    left = b""
    while True:
        data = left or stream.read(READ_SIZE)
        if not data:
            return
        z, buf, record = zlib.decompressobj(31), bytearray(), None
        need = None  # length of the whole record, when its header is known
        while not z.eof:
            if not data and not (data := stream.read(READ_SIZE)):
                raise ValueError("the file ends inside a record")
            buf += z.decompress(data)
            data = b""
            if need is None and (end := buf.find(b"\r\n\r\n")) >= 0:
                headers = _headers(bytes(buf[:end]))
                if not buf.startswith(b"WARC/") or "content-length" not in headers:
                    raise ValueError("not a WARC record")
                start = end + 4
                need = start + int(headers["content-length"]) + 4
            if need is not None and len(buf) > need:
                raise ValueError("more data than the content length says")
        left = z.unused_data
        if need is None or len(buf) != need or buf[-4:] != b"\r\n\r\n":
            raise ValueError("a record doesn't have its content length")
        record = Record(headers, bytes(buf[start:-4]))
        said = headers.get("warc-block-digest")
        if said and said != f"sha1:{sha1_32(record.block)}":
            raise ValueError("wrong block digest")
        if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")):
            if said != f"sha1:{sha1_32(record.http()[1])}":
                raise ValueError("wrong payload digest")
        yield record


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"{folder}/pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        out, n = None, 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if out is None:
                    out = _open(name, "w")
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name)),
                                      ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                                     b"format: WARC File Format 1.1\r\n"))
                out.write(page_record(*row, level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])
    return run


def write_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 6,
                id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per page; the stored manifest ``(file,
    n_records)``."""
    spark = pages.sparkSession
    ship_package(spark)
    html = text_or_empty(html_col)
    rows = spread(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                               html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest")))
    again = (rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
             .select("digest", "first"))
    again = stored(again, "digests")
    n = again.count()
    again = F.broadcast(again) if n <= BROADCAST_DIGESTS else again
    plan = (rows.join(again, "digest", "left")
            .select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
                    .alias("refers_to")))
    out = _uri(folder or scratch_path(spark, "warc"))
    return stored(plan.mapInArrow(_write(out, level), "file string, n_records long"), "manifest")


def _read(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, seen = [], 0
                with _open(name, "r") as stream:
                    for r in records(stream):
                        h = r.headers
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        http, body = r.http()
                        row = [int(h["page-id"]) if "page-id" in h else None, int(http["content-length"]),
                               h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"],
                               int(h["refers-to-page-id"]) if "refers-to-page-id" in h else None,
                               h.get("warc-target-uri")]
                        rows.append([*row, body if h["warc-type"] == "response" else None][:len(names)])
                        seen += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if seen != n:
                    raise ValueError(f"{name} has {seen} page records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return run


def read_pages(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per page record of the files; a revisit's payload is null,
    its digest and length are those of the full payload."""
    ship_package(manifest.sparkSession)
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
              + (", payload binary" if with_payload else ""))
    return (manifest.select("file", "n_records").repartition(max(1, manifest.count()))
            .mapInArrow(_read(with_payload), schema))
