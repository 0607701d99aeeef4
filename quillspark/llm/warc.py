"""WARC output: one monolithic gzip stream per part, normalised to a member per record with a sidecar offset index.

Writing goes in two steps per part. The records are first compressed as one gzip stream, as many crawlers leave them.
The normaliser then inflates that stream once from end to end, cuts it into records by their Content-Length, writes
every record again as a gzip member of its own and notes (offset, length, kind, record id) of each in a sidecar, so that
single records can be fetched by a ranged read. Reading back goes through that index. Every file begins with a warcinfo
record. A record's id names the page and, after ``#``, the file and the record's place in it, so that it is unique.

Of pages with equal payloads the one with the smallest ``page_id`` is the ``response``; the others are ``revisit`` records
without a payload that refer to it (and keep the payload's length in their HTTP header). Null html is an empty payload.
A null ``page_id`` never is the smallest while another exists; if all are null, all are responses. Rows that share the
smallest ``page_id`` of their payload are all responses. An empty table gives no file and no row. Other columns are
ignored, a missing ``url`` counts as null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, file string, n_records long, n_bytes long"
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
INDEX = struct.Struct("<QQQB")
KINDS = ["response", "revisit", "warcinfo"]
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def record_id(page_id: int | None, place: str = "") -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}{place and '#' + place}>"


def page_of(urn: str | None) -> int | None:
    name = (urn or "").rstrip(">").rpartition(":")[2].partition("#")[0]
    return int(name) if name.lstrip("-").isdigit() else None


def info_record(file: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{file}>", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, place: str = "") -> bytes:
    """A response record, or a revisit record if ``first`` is another page's id."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = first is not None and first != page_id
    block = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(page_id, place)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Monolith:
    """A whole-file gzip stream under construction."""

    def __init__(self, level: int = 1):
        self.deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
        self.parts: list[bytes] = []
        self.size = self.plain = 0

    def add(self, data: bytes) -> None:
        self.parts.append(part := self.deflate.compress(data))
        self.size += len(part)
        self.plain += len(data)

    def close(self) -> bytes:
        return b"".join([*self.parts, self.deflate.flush()])


def inflated(blob: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, in bounded steps."""
    rest = blob
    while rest:
        machine = zlib.decompressobj(31)
        data = machine.decompress(rest, step)
        while data or not machine.eof:
            if not data and not machine.unconsumed_tail:
                raise ValueError("truncated gzip stream")
            yield data
            data = machine.decompress(machine.unconsumed_tail, step) if not machine.eof else b""
        rest = machine.unused_data


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of plain WARC bytes into whole records, trailing blank lines included."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            found = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", held[at:end])
            if not found:
                raise ValueError("record without Content-Length")
            stop = end + 4 + int(found[1]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("truncated record")


def normalise(blob: bytes, level: int = 1) -> tuple[bytes, bytes]:
    """Rewrite a monolithic file as a member per record; the sidecar holds offset, length, plain length and kind of each."""
    out, index, at = [], [], 0
    for plain in records(inflated(blob)):
        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = machine.compress(plain) + machine.flush()
        out.append(member)
        index.append(INDEX.pack(at, len(member), len(plain), KINDS.index(kind_of(plain))))
        at += len(member)
    return b"".join(out), b"".join(index)


def kind_of(plain: bytes) -> str:
    """A record's type, from its own header alone."""
    found = re.search(rb"(?i)\r\nwarc-type:[ \t]*([a-z]+)", plain[: plain.index(b"\r\n\r\n")])
    return found[1].decode().lower() if found else ""


def index_entries(sidecar: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, length, plain length, number of the kind in ``KINDS``) of each record."""
    return list(INDEX.iter_unpack(sidecar))


def parsed(plain: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, kind, refers_to of a record."""
    cut = plain.index(b"\r\n\r\n")
    head = {k.strip().lower().decode(): v.decode() for k, v in HEADER.findall(plain[: cut + 2])}
    block = plain[cut + 4 : cut + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    payload = block[http_end + 4 :]
    kind = head["warc-type"]
    if kind == "revisit":
        size = int(re.search(rb"(?i)content-length:[ \t]*(\d+)", block[:http_end])[1])
        digest = head["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != head["warc-payload-digest"].partition(":")[2]:
            raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
    return page_of(head["warc-record-id"]), size, digest, kind, page_of(head.get("warc-refers-to"))


def first_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, html and the smallest page_id with the same payload (null where no other page has it)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload_key"))
    first = rows.groupBy("payload_key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a page in very many copies is dealt over several tasks
    found = common.skew_join(rows, common.staged(first, "payloads"), ["payload_key"], ["page_id", "url"], "left")
    return found.select("page_id", "url", "html", "first")


def write_warcs(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write ``<part>.warc.gz`` and ``<part>.idx`` files below ``folder``; the stored manifest has a row per file."""
    spark = pages.sparkSession
    common.ensure_workers(spark)
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, count, mono = TaskContext.get().partitionId(), 0, 0, Monolith(level)
        name = f"pages-{part:06d}-{seq:04d}"

        def flush() -> pa.RecordBatch:
            nonlocal seq, count, mono, name
            blob, index = normalise(mono.close(), level)
            common.write_file(folder, f"{name}.warc.gz", blob)
            common.write_file(folder, f"{name}.idx", index)
            row = (part, name, count, len(blob))
            seq, count, mono = seq + 1, 0, Monolith(level)
            name = f"pages-{part:06d}-{seq:04d}"
            return common.to_batch([row], schema)

        for batch in batches:
            for page_id, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
                if not count:
                    mono.add(info_record(f"{name}.warc.gz"))
                mono.add(record(page_id, url, html.as_py() or b"", first, f"{name}.{count}"))
                count += 1
                if mono.plain >= file_bytes:
                    yield flush()
        if count:
            yield flush()

    first_pages(pages).mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_warcs(spark: SparkSession, folder: str, step: int = 512) -> DataFrame:
    """A row per record, fetched through the sidecar indexes."""
    common.ensure_workers(spark)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(RECORD.names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                entries = index_entries(common.read_file(folder, f"{name}.idx"))
                system, path = common.filesystem(folder)
                with system.open_input_file(f"{path}/{name}.warc.gz") as src:
                    for at in range(0, len(entries), step):
                        some = entries[at : at + step]
                        src.seek(some[0][0])
                        raw = src.read(some[-1][0] + some[-1][1] - some[0][0])
                        rows = []
                        for offset, length, _, kind in some:
                            if KINDS[kind] == "warcinfo":
                                continue
                            member = raw[offset - some[0][0] :][:length]
                            rows.append((*parsed(zlib.decompress(member, 31)), f"{name}.warc.gz", offset, length))
                        if rows:
                            yield common.to_batch(rows, schema)

    cores = max(spark.sparkContext.defaultParallelism, 1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file").repartition(4 * cores, "file").mapInArrow(run, RECORD)


def warc_digest(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` and return what reading them back shows of each page."""
    folder = folder or common.staging(pages.sparkSession, "warc")
    write_warcs(pages, folder)
    return read_warcs(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
