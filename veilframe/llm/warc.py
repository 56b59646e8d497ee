"""WARC archives: writing, normalising a whole-file gzip stream to one member a record, and reading by offset.

``normalise`` inflates a stream once, from the first byte to the last, and rewrites every record as a gzip member of
its own, with a side-car index of (offset, length, type, record id). Nothing larger than a header and a chunk is held.
``archive`` writes a DataFrame's records as such archives, one for each partition, into a folder that all executors
share; a file's name is new for each attempt, and only the attempts whose rows are committed are read. ``read`` gets
the records back by the index.

Defined cases: null html is an empty payload; a null url is written as the record id; control characters in a url are
escaped; a null page id counts below all others; of rows with one page id and payload each is a response where that id
is the largest; an empty table gives no rows. The operator reads the columns page_id, url and html only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import Workspace, join_heavy_apart

#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
CHUNK = 1 << 16
#: Largest header block of a record; more is an error, not a record.
HEADER_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ESCAPED = "/:?#[]@!$&'()*+,;=%~"


class Entry(NamedTuple):
    offset: int
    length: int
    type: str
    record_id: str


class Inflated:
    """Reads a gzip stream of one or more members, inflating each byte once."""

    def __init__(self, source: BinaryIO):
        self.source, self.buffer, self.inflater = source, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.inflater.eof:
                rest, self.inflater = self.inflater.unused_data, zlib.decompressobj(31)
            else:
                rest = self.inflater.unconsumed_tail
            data = rest or self.source.read(CHUNK)
            if not data:
                return False
            if out := self.inflater.decompress(data, CHUNK):
                self.buffer += out
                return True

    def header(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > HEADER_BYTES:
                raise ValueError("a record's header doesn't end")
            if not self.more():
                if self.buffer.strip(b"\r\n"):
                    raise ValueError("the stream ends within a record's header")
                return None
        out, self.buffer = self.buffer[: end + 4], self.buffer[end + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the stream ends within a record")
            out, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(out)
            yield out


def field(header: bytes, name: str) -> str:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace") if found else ""


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[Entry]:
    """Rewrite a gzip stream of records with a member for each record; yields the index."""
    stream, at = Inflated(source), 0
    while (header := stream.header()) is not None:
        header = header.lstrip(b"\r\n")
        member, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        size += put(target, member.compress(header))
        for part in stream.take(int(field(header, "Content-Length"))):
            size += put(target, member.compress(part))
        for _ in stream.take(4):
            pass
        size += put(target, member.compress(b"\r\n\r\n") + member.flush())
        yield Entry(at, size, field(header, "WARC-Type"), field(header, "WARC-Record-ID"))
        at += size


def put(target: BinaryIO, data: bytes) -> int:
    if data:
        target.write(data)
    return len(data)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of refers_to."""
    own = f"urn:page:{'' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, ESCAPED) if url else own}"]
    lines += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_of(urn: str) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn)
    return int(found[1]) if found else None


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    return (fs.LocalFileSystem(), urlsplit(uri).path) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def archive(records: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, html, refers_to as archives into the folder; a row (archive, index, records) for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}"
        n, packed = 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        with files.open_output_stream(f"{name}.whole.gz", compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    put(out, packed.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), refers_to.as_py())))
                    n += 1
            put(out, packed.flush())
        if n:
            with files.open_input_stream(f"{name}.whole.gz", compression=None) as source, files.open_output_stream(f"{name}.warc.gz", compression=None) as target, files.open_output_stream(f"{name}.idx", compression=None) as index:
                for x in normalise(source, target):
                    index.write(("\t".join(map(str, x)) + "\n").encode())
            yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "index": [f"{name}.idx"], "records": pa.array([n], pa.int64())})
        files.delete_file(f"{name}.whole.gz")

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, index string, records long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and html of every record."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def parse(member: bytes) -> tuple:
        data = zlib.decompress(member, 31)
        header, _, block = data.partition(b"\r\n\r\n")
        block = block[: int(field(header, "Content-Length"))]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, refers_to = field(header, "WARC-Type"), page_of(field(header, "WARC-Refers-To"))
        if kind == "revisit":
            return page_of(field(header, "WARC-Record-ID")), field(header, "WARC-Target-URI"), kind, refers_to, int(field(http, "Content-Length")), field(header, "WARC-Payload-Digest").removeprefix("sha1:"), None
        return page_of(field(header, "WARC-Record-ID")), field(header, "WARC-Target-URI"), kind, refers_to, len(payload), hashlib.sha1(payload).hexdigest(), payload.decode("utf-8")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(folder)
        for batch in batches:
            for path, index in zip(batch["archive"].to_pylist(), batch["index"].to_pylist(), strict=True):
                with files.open_input_file(path) as source, files.open_input_stream(index, compression=None) as lines:
                    out, held = [], 0
                    for line in lines.read().decode().splitlines():
                        offset, length = map(int, line.split("\t")[:2])
                        out.append(parse(source.read_at(length, offset)))
                        held += len(out[-1][-1] or "")
                        if held > 1 << 23 or len(out) == 4096:
                            yield table(out)
                            out, held = [], 0
                    if out:
                        yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    spread = archives.select("archive", "index").repartition(max(1, min(archives.count(), 100_000)), "archive")
    return spread.mapInArrow(rows, schema)


def revisits(pages: DataFrame, work: Workspace, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the records whose payload another record holds."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("bytes"))
    rows = work.keep(rows.filter(F.col("bytes") >= least).select("page_id", "digest"), "payloads")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1 and refers_to is not null")
    groups = work.keep(groups, "shared")
    found = join_heavy_apart(rows, groups, "digest", "n", rows.count())
    return work.keep(found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct(), "revisits")


def round_trip(pages: DataFrame, work: Workspace) -> DataFrame:
    """Write the pages' archives into the workspace and read them back."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = revisits(pages, work).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    digest = F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    records = pages.withColumn("digest", digest)
    records = records.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    archives = work.keep(archive(records, work.path("warc")), "archives")
    return read(archives, work.path("warc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row per page, from the archives read back."""
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), Workspace(spark, "op3"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
