"""WARC archives: a committing writer and a splittable reader, as one Spark data source.

Every record is a gzip member of its own. The writer's tasks write files under
names of their own, and only the files of tasks that the driver commits are
listed in the manifest, so retried or speculative tasks leave nothing behind
that is read. The reader deals byte ranges of the files to tasks: a task looks
for the gzip magic from its start, takes a candidate for a member only if it
decodes to a WARC header, and owns every record that starts inside its range,
reading past the range's end where the last record does.

Files are opened through pyarrow's file systems by the path's scheme, so the
folder can be local to all (file://), hdfs:// or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common, vector_codes

#: Bytes of a task's range.
SPLIT_BYTES = 32 << 20
#: Bytes read from a file at once.
READ_BYTES = 1 << 20
#: Records with payloads shorter than this are never revisits.
LEAST_PAYLOAD = 0
#: zlib level of the members.
LEVEL = 4
#: Records carry no crawl time of their own, so archives of the same pages are the same bytes.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: Each commit adds a manifest of its own; a read takes all of them.
MANIFEST = "_manifest-"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit that holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(data: bytes) -> tuple:
    """The fields of SCHEMA from an unpacked member; a response's length and digest are taken from its payload."""
    from urllib.parse import unquote

    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda key: int(x) if (x := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    url = unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return number("warc-record-id"), url, "revisit", full, said, number("warc-refers-to"), None
    digest = base32_sha1(payload)
    if digest != said:
        raise ValueError(f"payload of page {number('warc-record-id')} doesn't have the digest in its header")
    return number("warc-record-id"), url, "response", len(payload), digest, None, payload


def members(source, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes | None]]:
    """Place and unpacked bytes of the WARC members that start in [start, stop) of an open file, read in pieces; None for what is damaged.

    Before the first member of a range, bytes that look like one but don't
    decode to a WARC header belong to a member that started earlier. Where a
    member ends (and at the file's start) the next must begin: if it doesn't,
    or if its header is right but the rest isn't, it is damaged, and the search
    goes on behind it. A range looks at the header that follows its last member
    too, so each damage is told once, by one range.
    """
    at, sure, held, base = start, start == 0, b"", start

    def fill(upto: int) -> None:
        """Hold the file's bytes from at to upto, if the file has them."""
        nonlocal held, base
        held, base = held[at - base :], at
        missing = min(upto, size) - (base + len(held))
        if missing > 0:
            source.seek(base + len(held))
            held += source.read(missing)

    def unpack(header_only: bool) -> tuple[bool, bytes | None, int]:
        """Of the member at ``at``: whether its header is right, its bytes if all of it is, and where it ends."""
        packed, parts, checked, fed = zlib.decompressobj(31), [], False, at
        try:
            while not packed.eof:
                if fed < base + len(held):
                    chunk = held[fed - base :]
                else:
                    source.seek(fed)
                    chunk = source.read(READ_BYTES)
                    if not chunk:
                        break
                fed += len(chunk)
                if part := packed.decompress(chunk):
                    parts.append(part)
                if not checked and sum(map(len, parts)) >= 7:
                    parts, checked = [b"".join(parts)], True
                    if not parts[0].startswith(b"WARC/1."):
                        return False, None, fed
                    if header_only:
                        return True, None, fed
        except zlib.error:
            return checked, None, fed
        return checked, b"".join(parts) if checked and packed.eof else None, fed - len(packed.unused_data)

    while at < size:
        fill(at + READ_BYTES)
        if at >= stop:
            if sure and not unpack(True)[0]:
                yield at, None
            return
        if not sure:
            found = held.find(MAGIC)
            if found < 0:
                at = max(at + 1, base + len(held) - len(MAGIC) + 1)
                continue
            at += found
            if at >= stop:
                return
        header, data, end = unpack(False)
        if data is not None:
            yield at, data
            at, sure = end, True
            if at > base + len(held):
                held, base = b"", at
        else:
            if header or sure:
                yield at, None
            at, sure = at + 1, False


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int
    size: int


@dataclass
class _Written(WriterCommitMessage):
    name: str
    records: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.payload = options["path"], int(options.get("splitbytes", SPLIT_BYTES)), options.get("payload", "true") == "true"
        self.skip = options.get("damaged", "fail") == "skip"

    def partitions(self):
        system, root = _open(self.path)
        names = []
        for path in _manifests(system, root):
            with system.open_input_stream(path) as f:
                names += json.loads(f.read())
        out = []
        for info in system.get_file_info([posixpath.join(root, n) for n in names]):
            out += [_Range(info.path, s, min(s + self.split, info.size), info.size) for s in range(0, info.size, self.split)]
        return out

    def read(self, partition):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        if partition is None:
            return
        system, _ = _open(self.path)
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        with system.open_input_file(partition.path) as f:
            for at, data in members(f, partition.start, partition.stop, partition.size):
                try:
                    if data is None:
                        raise ValueError("not a whole WARC record")
                    row = decode_record(data)
                except (ValueError, KeyError, StopIteration) as error:
                    if not self.skip:
                        raise ValueError(f"{partition.path}, byte {at}: {error}") from error
                    row = (None, partition.path, "damaged", at, None, None, None)
                rows.append(row if self.payload else (*row[:-1], None))
                held += len(data or b"") if self.payload else 100
                if held > 16 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(posixpath.join(root, name), compression=None) as out:
            for batch in iterator:
                for page, url, payload, digest, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(encode_record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, revisit))
                    n += 1
        return _Written(name, n)

    def commit(self, messages):
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        before = _manifests(system, root)
        with system.open_output_stream(posixpath.join(root, f"{MANIFEST}{uuid.uuid4().hex}.json"), compression=None) as out:
            out.write(json.dumps(sorted(m.name for m in messages if m is not None and m.records)).encode())
        for path in before if self.overwrite else ():
            system.delete_file(path)

    def abort(self, messages):
        system, root = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(posixpath.join(root, m.name))


def _manifests(system: fs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if posixpath.basename(i.path).startswith(MANIFEST))


class WarcSource(DataSource):
    """Format ``warc``; options path, splitBytes, payload=false to leave payloads where they are, and damaged=skip.

    A record that can't be read whole is an error; with damaged=skip it is a row
    of record_type ``damaged`` with its file as url and its place as
    payload_bytes, so that a read tells how many it left out.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """The pages as records to write: page_id, url, payload, digest (hex), refers_to, revisit.

    A null html is an empty payload. Of equal payloads of at least ``least``
    bytes the record with the smallest page_id is the response (a row repeated
    under that id too, and null ids only among themselves); others revisit it.
    Only ids and digests are shuffled to decide this (those of a payload that
    many pages share meet its first page by a broadcast), and the payloads at
    most once to meet the decisions. A record is made and read whole, so a very long
    payload takes memory for itself once. An empty table makes no record; other
    columns, whatever their names, are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = common.cut(rows.filter(F.octet_length("payload") >= least).select("page_id", "digest"), "payloads")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = vector_codes.looked_up(slim, first, ["digest"], "n", slim.count()).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("page_id").alias("a_id"), F.col("digest").alias("a_digest"), "refers_to")
    out = rows.join(again, F.col("page_id").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest")), "left")
    return out.select("page_id", "url", "payload", "digest", "refers_to", F.col("a_digest").isNotNull().alias("revisit"))


def write(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD) -> None:
    """Add the pages' records to the archives of a folder. Revisits are told within one write, not between writes."""
    pages.sparkSession.dataSource.register(WarcSource)
    records(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT_BYTES, damaged: str = "fail") -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split).option("payload", str(payload).lower()).option("damaged", damaged).load(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits of the digest are four of base 32.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {shift}) & 31) + 1)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0))
QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""
}
