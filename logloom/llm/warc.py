"""Operator 8: WARC archives, and the normaliser of monolithic gzip files.

1. write     each task writes its records into one file that is a single gzip stream, as careless crawlers do.
2. normalise each such file is inflated once, as a stream; every record becomes a gzip member of its own, and a sidecar
             index (a line of JSON a record: offset, length, type, record id) is written beside it.
3. read      records are read back by the index's offsets, each member for itself.

Files go to the shared folder through Arrow's file systems. A task names its files by itself and reports them in a table;
what a lost or repeated attempt has left is in no table and is never read. A file is as large as a task's input; records
are held one at a time.

Records with equal payloads of LEAST_REVISIT bytes or more: that with the largest page_id is the response, others are
revisits of it, without a payload but with its digest and the HTTP header that tells its length.

Defined results: null html is an empty payload; a null page_id is kept as null (its record id has no number, and its
record is a revisit if another page has the same payload); pages that repeat the largest page_id are all responses; urls
are percent-encoded where they would break a header; the capture date is fixed, for the table has none; an empty table
gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, fresh, open_fs, slices, small_batches, stored, table

LEAST_REVISIT = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
ROWS = 2000
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record of an HTTP response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}",
        **({"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE} if revisit else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n")[1:] if line)}


class Inflater:
    """The inflated bytes of a gzip stream (any number of members), read forward once."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.zip, self.data, self.done = raw, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        chunk = self.zip.unused_data or self.raw.read(CHUNK)
        if not chunk:
            self.done = True
            return False
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        self.data += self.zip.decompress(chunk)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with the mark; None at the end of the stream."""
        start = 0
        while (at := self.data.find(mark, start)) < 0:
            start = max(0, len(self.data) - len(mark))
            if not self.more():
                if self.data.strip():
                    raise ValueError("the archive ends within a header")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def records(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and the whole bytes of each record of an archive, one at a time."""
    stream = Inflater(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = headers(head)
        yield fields, head + stream.take(int(fields["content-length"]) + 4)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit for every row."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size"))
    groups = rows.where(f"size >= {LEAST_REVISIT}").groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1 and last is not null").select("digest", "size", "last"), "payloads")
    rows = rows.join(groups, ["digest", "size"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame) -> DataFrame:
    """Writes the pages as monolithic archives. Returns path and n_records of each."""
    small_batches(pages.sparkSession)
    folder = fresh(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        path, n, out = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, None
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch in slices(batches, "html"):
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(path, compression=None)
            for r in batch.to_pylist():
                out.write(pack.compress(record(r["page_id"], r["url"], r["html"].encode("utf-8", "replace"), r["digest"], r["refers_to"], r["revisit"])))
                n += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path.removeprefix(top)], "n_records": [n]})

    return stored(planned(pages).mapInArrow(run, "path string, n_records long").select(F.concat(F.lit(folder), "path").alias("path"), "n_records"), "written")


def normalise(archives: DataFrame) -> DataFrame:
    """archives(path): gzip archives of any kind. Returns path, index (its sidecar) and n_records of the files in which
    every record is its own member."""
    spark = archives.sparkSession
    folder = fresh(spark, "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, source = open_fs(path)
                fs_out, top = open_fs(folder)
                fs_out.create_dir(top, recursive=True)
                name, n, at = f"/{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(source, compression=None) as raw, fs_out.open_output_stream(top + name, compression=None) as out, fs_out.open_output_stream(top + name + ".index", compression=None) as index:
                    for fields, data in records(raw):
                        pack = zlib.compressobj(5, zlib.DEFLATED, 31)
                        member = pack.compress(data) + pack.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}).encode() + b"\n")
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n]})

    files = dealt(archives.select("path")).mapInArrow(run, "path string, n_records long")
    return stored(files.select(F.concat(F.lit(folder), "path").alias("path"), F.concat(F.lit(folder), "path", F.lit(".index")).alias("index"), "n_records"), "normalised")


def parsed(data: bytes) -> dict:
    """The row of a record. A response's digest and size are those of the payload that it holds."""
    head, _, block = data[:-4].partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "payload_bytes": int(headers(http)["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"]) if revisit else None,
        "url": fields["warc-target-uri"],
    }


def lookup(path: str, offset: int, length: int) -> bytes:
    """The bytes of the record at an index entry."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def read(archives: DataFrame) -> DataFrame:
    """archives(path, index): the rows of all records, each member read by its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                fs, name = open_fs(path)
                rows: list[dict] = []
                with fs.open_input_file(name) as f, fs.open_input_stream(open_fs(index)[1], compression=None) as entries:
                    for line in _lines(entries):
                        entry = json.loads(line)
                        f.seek(entry["offset"])
                        rows.append(parsed(zlib.decompress(f.read(entry["length"]), 31)))
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return dealt(archives.select("path", "index")).mapInArrow(run, SCHEMA)


def _lines(stream: BinaryIO) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(normalise(write(table(spark, sf_dir, "pages")))).drop("url")


OP8_SQL = f"""
with rows as (select page_id, coalesce(html, '') as html from pages),
sized as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest, html from rows),
lasts as (select html, max(page_id) as last, count(*) as n from sized where payload_bytes >= {LEAST_REVISIT} group by html)
select s.page_id, s.payload_bytes, s.payload_digest,
       case when n > 1 and s.page_id <> last then 'revisit' else 'response' end as record_type,
       case when n > 1 and s.page_id <> last then last end as refers_to
from sized s left join lasts l on s.html = l.html and s.payload_bytes >= {LEAST_REVISIT}
"""
