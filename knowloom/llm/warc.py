"""WARC records in ZIP packages: written as stored members with an index, read back by ranges without extraction.

A package holds `archive/data.warc.gz` (one gzip member per record) and `indexes/index.cdxj` (one line per record with
its offset and length), both stored. The reader parses the end record, the ZIP64 records and the central directory,
finds where the stored members' bytes start, and reads each record by its range.

Packages lie in the folder that driver and executors share. A task writes under a name of its own and returns it, and
only the returned names (a written table) are read, so tasks that were lost or run twice do no harm.

Cases: null html is an empty payload; of rows with equal payloads those of the largest page_id (null the smallest) are
responses and the others revisit it, so rows that repeat it wholly are responses too; an empty table gives no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_RECORDS, PACKAGE_BYTES = 20_000, 256 << 20
CHUNK = 256
READ = 8 << 20
STAMP = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 0


# --- ZIP packages ---


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header_at: int
    crc: int


def zip64_extra(extra: bytes, size: int, packed: int, at: int) -> tuple[int, int, int]:
    """The sizes and place that the ZIP64 extra field holds where the 32-bit ones are all ones."""
    i = 0
    while i + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, i)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
            size = next(values) if size == 0xFFFFFFFF else size
            packed = next(values) if packed == 0xFFFFFFFF else packed
            at = next(values) if at == 0xFFFFFFFF else at
        i += 4 + n
    return size, packed, at


def read_range(f, at: int, n: int) -> bytes:
    f.seek(at)
    out = f.read(n)
    if len(out) != n:
        raise ValueError(f"{n} bytes wanted at {at}, {len(out)} found")
    return out


def central_directory(f, size: int) -> list[Member]:
    """The members of a ZIP file of `size` bytes that f reads."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read_range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no ZIP end record")
    n, length, at = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (found := read_range(f, locator, 20))[:4] == b"PK\x06\x07":
        end64 = read_range(f, struct.unpack_from("<Q", found, 8)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, length, at = struct.unpack_from("<QQQ", end64, 32)
    raw, out, i = read_range(f, at, length), [], 0
    for _ in range(n):
        if raw[i : i + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, crc, packed, full, n_name, n_extra, n_comment, header_at = *struct.unpack_from("<H", raw, i + 10), *struct.unpack_from("<IIIHHH", raw, i + 16), *struct.unpack_from("<I", raw, i + 42)
        name, extra = raw[i + 46 : i + 46 + n_name], raw[i + 46 + n_name : i + 46 + n_name + n_extra]
        full, packed, header_at = zip64_extra(extra, full, packed, header_at)
        out.append(Member(name.decode("utf-8", "replace"), method, full, packed, header_at, crc))
        i += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: only stored members can be read by range")
    header = read_range(f, member.header_at, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))


# --- WARC records ---


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:knowloom:page:{'' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {STAMP}", f"WARC-Target-URI: {clean}"]
    if revisit:
        head += [f"WARC-Refers-To: {page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and digest(payload) != said:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return {
        "page_id": urn_page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": int(headers["warc-payload-length"]) if revisit else len(payload),
        "payload_digest": said, "record_type": headers["warc-type"], "refers_to": urn_page(headers.get("warc-refers-to")),
    }


# --- Spark ---


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI (file, s3, gs, hdfs, ...) or local path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def shared_uri(root: str) -> str:
    return "file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root


def write_packages(root: str, records: int = PACKAGE_RECORDS, size: int = PACKAGE_BYTES):
    """Rows (page_id, url, html, top, revisit) to packages under root; a row (path, records) for each."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for lo in range(0, b.num_rows, 200) for r in zip(*(c.to_pylist() for c in b.slice(lo, 200).columns), strict=True))
        row = next(rows, None)
        while row is not None:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            fs, at = open_store(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            lines, offset = [], 0
            with fs.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                    while row is not None and len(lines) < records and offset < size:
                        page_id, url, html, top, revisit = row
                        raw = gzip.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), top, revisit), 1, mtime=0)
                        data.write(raw)
                        lines.append(json.dumps({"id": page_id, "offset": offset, "length": len(raw)}))
                        offset += len(raw)
                        row = next(rows, None)
                package.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines) + "\n")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64())], schema=schema)

    return run, "path string, records long"


def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages (path) to ranges of their records: (path, offsets, lengths), absolute, CHUNK records each."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = open_store(path)
            with fs.open_input_file(at) as f:
                members = {m.name: m for m in central_directory(f, f.size())}
                start, index = data_start(f, members[DATA]), members[INDEX]
                lines = [json.loads(x) for x in read_range(f, data_start(f, index), index.size).splitlines()]
            for lo in range(0, len(lines), CHUNK):
                part = lines[lo : lo + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[start + x["offset"] for x in part]], pa.list_(pa.int64())), pa.array([[x["length"] for x in part]], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])


def read_records(with_payload: bool):
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not with_payload:
        columns = {k: v for k, v in columns.items() if k not in ("url", "payload")}
    schema = pa.schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_store(path)
                with fs.open_input_file(at) as f:
                    i = 0
                    while i < len(offsets):
                        j, stop = i + 1, offsets[i] + lengths[i]
                        while j < len(offsets) and offsets[j] == stop and stop + lengths[j] - offsets[i] <= READ:
                            stop += lengths[j]
                            j += 1
                        raw = read_range(f, offsets[i], stop - offsets[i])
                        found = [parse_record(zlib.decompress(raw[o - offsets[i] : o - offsets[i] + n], 31)) for o, n in zip(offsets[i:j], lengths[i:j], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in columns.items()], schema=schema)
                        i = j

    return run, ", ".join(f"{k} {'long' if v == pa.int64() else 'binary' if v == pa.binary() else 'string'}" for k, v in columns.items())


def write_warc(pages: DataFrame, scratch: Scratch, root: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as packages under root; the table of packages (path, records)."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("key"))
    same = keyed.where(F.octet_length("html") >= min_revisit).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    same = scratch.keep(same.withColumn("copied", F.lit(True)), "copies")
    rows = join_hot(keyed, same, "key", "n", max(1, keyed.count()), "left")
    revisit = F.coalesce(F.col("copied"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("top"))
    run, schema = write_packages(root)
    return scratch.keep(rows.select("page_id", "url", "html", "top", revisit.alias("revisit")).mapInArrow(run, schema), "packages")


def read_warc(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of packages (path, records)."""
    run, schema = read_records(with_payload)
    parts = max(packages.sparkSession.sparkContext.defaultParallelism, (packages.agg(F.sum("records")).first()[0] or 0) // 20_000)
    chunks = packages.select("path").repartition(parts).mapInArrow(list_chunks, "path string, offsets array<long>, lengths array<long>")
    return chunks.repartition(parts).mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_warc(write_warc(pages, scratch, shared_uri(f"{scratch.root}/archives")), with_payload=False)


def open_bytes(data: bytes) -> tuple[io.BytesIO, int]:
    return io.BytesIO(data), len(data)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) || '00' AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(5 * i // 4 + 1 AS INTEGER), 3) AS INTEGER) >> CAST(7 - 5 * i % 4 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p
"""
