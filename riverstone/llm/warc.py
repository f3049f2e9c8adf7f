"""WARC archives: one gzip member for each record, written by tasks to the shared store and read back sequentially.

The reader inflates one member at a time in pieces of READ bytes, frames the block by Content-Length, and checks block and payload
digests; a damaged record raises WarcError with the file and the offset of its member.

The writer works before anything is known of other pages: each task writes the pages of its scan as responses and notes where each stands
and its digest. Notes are classified, and each file is copied: members of responses as they are, the others as revisits. Of records with
equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a response and the others revisit it.

Defined cases. Null html or url counts as empty. Rows that repeat a page_id are records of their own; of equal payloads with the smallest
page_id twice, each of those rows is a response. A null page_id is written without one and sorts last; where no copy has an id, each is a
response. An empty table gives no archive and no rows. Other columns are ignored. A page is in memory whole where it is written and read.

At scale. Only digests, ids, urls and places are shuffled, digests pre-aggregated in each task; the html goes straight from the scan to a
file and from there to the archive, which costs its compressed bytes on disk once more while both are there. A file is cut at
`max_file_bytes`, and one task copies it with the notes of its records; a lost task writes its file again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import bounded_batches, drop_path, new_path, read_table, row_slices, write_table
from riverstone.llm.files import open_file, open_stream, write_whole

MIN_REVISIT = 100
READ = 1 << 16
MAX_HEAD = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
MAX_FILE = 256 << 20


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    http: bytes = field(default=b"")

    @property
    def payload(self) -> bytes:
        return self.block[self.block.find(b"\r\n\r\n") + 4 :] if self.headers.get("Content-Type", "").startswith("application/http") else self.block


def record_bytes(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member. Line ends in header values become spaces."""
    head = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str, payload: bytes | int, digest: str, refers_to: int | None) -> bytes:
    """payload: of revisits, its length is enough."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(payload if isinstance(payload, int) else len(payload)))]
    return record_bytes(headers, block)


def read_records(stream, name: str = "") -> Iterator[Record]:  # noqa: ANN001
    """Records of an archive one after the other; memory is that of one record."""
    fresh, offset, more = b"", 0, True
    while True:
        if not fresh:
            fresh = stream.read(READ)
            if not fresh:
                return
        unpack, data, at, used = zlib.decompressobj(31), bytearray(), offset, 0
        head_end, need, headers = -1, None, {}
        while not unpack.eof:
            if not fresh:
                fresh = stream.read(READ)
                if not fresh:
                    raise WarcError(f"{name}: the member at {at} ends early")
            try:
                data += unpack.decompress(fresh, READ)
            except zlib.error as e:
                raise WarcError(f"{name}: the member at {at} is damaged: {e}") from e
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            used += len(fresh) - len(left)
            fresh = left
            if head_end < 0 and (head_end := data.find(b"\r\n\r\n")) >= 0:
                headers = _headers(bytes(data[:head_end]), name, at)
                need = head_end + 4 + int(headers["Content-Length"]) + 4
            if head_end < 0 and len(data) > MAX_HEAD or need is not None and len(data) > need:
                raise WarcError(f"{name}: the record at {at} is longer than it says")
        if need is None or len(data) != need or data[-4:] != b"\r\n\r\n":
            raise WarcError(f"{name}: the record at {at} isn't framed as its Content-Length says")
        record = Record(headers, bytes(data[head_end + 4 : -4]), at)
        _verify(record, name)
        offset = at + used
        yield record


def _headers(head: bytes, name: str, at: int) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"{name}: no WARC record at {at}")
    out = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if not out.get("Content-Length", "").isdigit():
        raise WarcError(f"{name}: the record at {at} has no Content-Length")
    return out


def _verify(r: Record, name: str) -> None:
    checks = [("WARC-Block-Digest", r.block)] + [("WARC-Payload-Digest", r.payload)] * (r.headers.get("WARC-Type") != "revisit")
    for key, data in checks:
        kind, _, want = r.headers.get(key, "").partition(":")
        if kind == "sha256" and hashlib.sha256(data).hexdigest() != want:
            raise WarcError(f"{name}: {key} of the record at {r.offset} doesn't hold")


def _cut_files(rows: Iterator[tuple[bytes, tuple]], name: str, max_bytes: int) -> Iterator[tuple[str, list[tuple]]]:
    """Writes members to files cut at so many bytes; each file's path and rows: offset, length, and what stood beside the member."""
    row, k = next(rows, None), 0
    while row is not None:
        path, at, made = f"{name}-{k:04d}.warc.gz", 0, []
        with write_whole(path) as out:
            while row is not None and at < max_bytes:
                member, own = row
                out.write(member)
                made.append((at, len(member), *own))
                at, row = at + len(member), next(rows, None)
        k += 1
        yield path, made


RAW = "path string, offset long, length long, page_id long, url string, digest string, size long"


def write_pages(pages: DataFrame, uri: str, max_file_bytes: int = MAX_FILE) -> DataFrame:
    """Writes each page as a response under uri, straight from the scan; where each of them stands, and its digest: RAW."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[bytes, tuple]]:
            for b in row_slices(batches, 2):
                for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    digest = hashlib.sha256(html).hexdigest()
                    yield page_record(page_id, url, html, digest, None), (page_id, url, digest, len(html))

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for path, rows in _cut_files(members(), f"{uri}/page-{TaskContext.get().partitionId():06d}", max_file_bytes):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([pa.array([path] * len(rows)), *columns], [x.split()[0] for x in RAW.split(", ")])

    empty = lambda k: F.coalesce(k, F.lit("")).alias(k)
    return write_table(pages.select(F.col("page_id").cast("long").alias("page_id"), empty("url"), empty("html")).mapInArrow(kernel, RAW), "pages")


def classify(written: DataFrame) -> DataFrame:
    """RAW rows and refers_to: null for responses. No payload is needed for that."""
    large = written.filter(F.col("size") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").select("digest", "first_id")
    later = F.col("page_id").isNull() | (F.col("first_id") < F.col("page_id"))
    return written.join(first, "digest", "left").select(*written.columns, F.when(later, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, uri: str, max_file_bytes: int = MAX_FILE) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under uri; the list of files: path, records, bytes."""
    spark = pages.sparkSession
    bounded_batches(spark)
    raw = new_path(spark, "warc-pages")
    classified = classify(write_pages(pages, raw, max_file_bytes))

    def copied(key, table):  # noqa: ANN001, ANN202
        """A file of responses to an archive: members of responses as they are, revisits in place of the others."""
        path = key[0].as_py()
        rows = sorted(table.select(["offset", "length", "page_id", "url", "digest", "size", "refers_to"]).to_pylist(), key=lambda r: r["offset"])

        def members(stream) -> Iterator[tuple[bytes, tuple]]:  # noqa: ANN001
            for r in rows:
                if r["refers_to"] is None:
                    stream.seek(r["offset"])
                    yield stream.read(r["length"]), ()
                else:
                    yield page_record(r["page_id"], r["url"], r["size"], r["digest"], r["refers_to"]), ()

        name = path.rpartition("/")[2].removesuffix(".warc.gz")
        with open_file(path) as stream:
            made = [(p, len(own), sum(x[1] for x in own)) for p, own in _cut_files(members(stream), f"{uri}/{name}", 2 * max_file_bytes + MAX_HEAD)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    made = classified.groupBy("path").applyInArrow(copied, "path string, records long, bytes long")
    files = write_table(made, "archives")
    drop_path(spark, raw)
    return files


def read_archives(files: DataFrame) -> DataFrame:
    """Files of archives (column path) to records: path, offset, page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        page = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        for path in (x for b in batches for x in b.column(0).to_pylist()):
            rows, held = [], 0
            with open_stream(path) as stream:
                for r in read_records(stream, path):
                    h, body = r.headers, r.payload
                    revisit = h["WARC-Type"] == "revisit"
                    rows.append((path, r.offset, page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], page(h.get("WARC-Refers-To")), h["WARC-Payload-Digest"].partition(":")[2] if revisit else hashlib.sha256(body).hexdigest(), int(h["X-Payload-Length"]) if revisit else len(body), None if revisit else body))
                    held += len(r.block) + 300
                    if held > 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    spread = files.select("path").repartitionByRange(max(1, files.count()), "path")  # a range for each file, so a file for each task
    return spread.mapInArrow(kernel, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, then reads them back; every column comes from the archives."""
    files = write_archives(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


NAME = "op8_warc"
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM q
"""
