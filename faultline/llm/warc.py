"""WARC archives as a PySpark Python data source.

Reading plans the files' splits (the writer notes where records start, every ``SPLIT_BYTES``; a foreign
file is one split), pushes predicates on record type and header columns into the
scan, parses a record's headers first and decodes its payload only if the record is wanted and the
schema asks for it. Compressed archives hold one gzip member a record; the writer notes each member's
compressed length in the gzip header (subfield ``sl``), so an unwanted record is stepped over after
its first bytes. Archives without that note are decompressed through.

Defined results: a null payload is empty; a null URI is left out of the header and read as null; line
breaks in a URI are percent-encoded; equal payloads of at least ``SMALL`` bytes keep one response,
that of the smallest page_id, the others revisit it (null ids never are the smallest unless all are;
repeated rows with the smallest id are all responses); an empty table writes no record.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .storage import shared_folder

SMALL = 100
#: An archive is read in pieces of about this size, each by a task of its own.
SPLIT_BYTES = 32_000_000
SCHEMA = "record_id string, record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Columns whose values stand in the record's headers, and so can be tested before decoding.
HEADER_COLUMNS = ("record_id", "record_type", "page_id", "target_uri", "payload_digest", "payload_bytes", "refers_to")
_PEEK = 4096
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- records ----------------------------------------------------------------------------------

def record_bytes(kind: str, page_id, uri: str | None, digest: str, size: int, refers_to, payload: bytes, date: str) -> bytes:
    """One WARC/1.0 record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells its own compressed and plain lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, (24 + len(body) + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(urn: str | None):
    text = (urn or "").strip("<>")
    return int(text[9:]) if text.startswith("urn:page:") and text[9:].lstrip("-").isdigit() else None


def header_row(h: dict[str, str]) -> dict:
    digest, size, uri = h.get("warc-payload-digest"), h.get("x-payload-length"), h.get("warc-target-uri")
    return {
        "record_id": h.get("warc-record-id", "").strip("<>") or None,
        "record_type": h.get("warc-type"),
        "page_id": _page(h.get("warc-record-id")),
        "target_uri": uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if uri is not None else None,
        "payload_digest": digest.rpartition(":")[2] if digest else None,
        "payload_bytes": int(size) if size else None,
        "refers_to": _page(h.get("warc-refers-to")),
    }


class _Plain:
    """Records of an uncompressed archive."""

    def __init__(self, source, start: int = 0, stop: int | None = None) -> None:
        self.source, self.size, self.at = source, source.size() if stop is None else stop, start

    def __iter__(self):
        while self.at < self.size:
            self.source.seek(self.at)
            buffer = b""
            while (end := buffer.find(b"\r\n\r\n")) < 0:
                more = self.source.read(_PEEK)
                if not more:
                    return
                buffer += more
            headers = parse_headers(buffer[:end].lstrip())
            start, length = self.at + end + 4, int(headers["content-length"])
            self.at = start + length + 4

            def block(start: int = start, length: int = length) -> bytes:
                self.source.seek(start)
                return self.source.read(length)

            yield headers, block


class _Gzip:
    """Records of an archive of gzip members; steps over unwanted ones by their noted length."""

    def __init__(self, source, start: int = 0, stop: int | None = None) -> None:
        self.source, self.size, self.at = source, source.size() if stop is None else stop, start

    def __iter__(self):
        while self.at < self.size:
            begin = self.at
            self.source.seek(begin)
            raw = self.source.read(_PEEK)
            skip = struct.unpack_from("<I", raw, 16)[0] if len(raw) >= 24 and raw[3] & 4 and raw[12:14] == b"sl" else None
            unpack = zlib.decompressobj(31)
            plain, fed = unpack.decompress(raw), len(raw)
            while (end := plain.find(b"\r\n\r\n")) < 0 and not unpack.eof:
                raw = self.source.read(_PEEK)
                if not raw:
                    raise ValueError("truncated gzip member")
                fed += len(raw)
                plain += unpack.decompress(raw)
            headers = parse_headers(plain[:end])
            state = {"plain": plain, "fed": fed}

            def finish(unpack=unpack, state=state, begin=begin) -> bytes:
                parts = [state["plain"]]
                self.source.seek(begin + state["fed"])
                while not unpack.eof:
                    raw = self.source.read(1 << 16)
                    if not raw:
                        raise ValueError("truncated gzip member")
                    state["fed"] += len(raw)
                    parts.append(unpack.decompress(raw))
                state["plain"] = b"".join(parts)
                return state["plain"]

            def block(finish=finish, end=end, headers=headers) -> bytes:
                return finish()[end + 4 : end + 4 + int(headers["content-length"])]

            yield headers, block
            if skip:
                self.at = begin + skip
            else:
                finish()
                self.at = begin + state["fed"] - len(unpack.unused_data)


def http_payload(headers: dict[str, str], block: bytes) -> bytes | None:
    if headers.get("warc-type") != "response":
        return None
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


# --- data source ------------------------------------------------------------------------------

def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class ArchiveFile(InputPartition):
    path: str
    start: int = 0
    stop: int | None = None


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int
    starts: list[int]
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema.fields])
        self.path = options["path"]
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADER_COLUMNS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((name, "given", None))
            else:
                yield f

    def partitions(self):
        fs, path = _located(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        listed = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        manifests = [x.path for x in listed if x.base_name.startswith("_manifest-")]
        if not manifests:
            return [ArchiveFile(prefix + x.path) for x in sorted(listed, key=lambda x: x.path) if x.base_name.endswith((".warc", ".warc.gz"))] or [ArchiveFile("")]
        pieces = []
        for m in manifests:
            with fs.open_input_file(m) as f:
                for name, starts, size in json.loads(f.read()):
                    pieces += [ArchiveFile(f"{self.path.rstrip('/')}/{name}", a, z) for a, z in zip(starts, [*starts[1:], size])]
        return sorted(pieces, key=lambda p: (p.path, p.start)) or [ArchiveFile("")]

    def wanted(self, row: dict) -> bool:
        for name, how, value in self.tests:
            v = row[name]
            if v is None or (how == "in" and v not in value) or (how == "starts" and not v.startswith(value)):
                return False
        return True

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = _located(partition.path)
        rows, held = [], 0
        with fs.open_input_file(path) as source:
            records = (_Gzip if source.read(2) == b"\x1f\x8b" else _Plain)(source, partition.start, partition.stop)
            for headers, block in records:
                row = header_row(headers)
                if not self.wanted(row):
                    continue
                if "payload" in self.columns or self.verify:
                    payload = http_payload(headers, block())
                    if self.verify and payload is not None:
                        if hashlib.sha256(payload).hexdigest() != row["payload_digest"] or len(payload) != row["payload_bytes"]:
                            raise ValueError(f"record {row['record_id']} does not hold its payload")
                    row["payload"] = payload
                    held += len(payload or b"") if "payload" in self.columns else 0
                rows.append(row)
                if len(rows) >= 5000 or held > 16_000_000:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in self.arrow], schema=self.arrow)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.packed = options.get("compression", "gzip") == "gzip"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, out, n, at, starts = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.packed else ""), None, 0, 0, [0]
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    fs, path = _located(f"{self.path}/{name}")
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                data = record_bytes(r["record_type"], r["page_id"], r["target_uri"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["payload"] or b"", self.date)
                data = gzip_member(data) if self.packed else data
                if at - starts[-1] >= SPLIT_BYTES:
                    starts.append(at)
                out.write(data)
                at += len(data)
                n += 1
        if out is not None:
            out.close()
        return Written(name if n else None, n, starts, at)

    def commit(self, messages) -> None:
        """Only files of successful tasks enter the manifest, and only those are read; by name, so a folder may move."""
        fs, path = _located(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([(m.name, m.starts, m.size) for m in messages if m and m.name]).encode())

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.name:
                fs, path = _located(f"{self.path}/{m.name}")
                fs.delete_file(path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; register it on the session first."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- operator ---------------------------------------------------------------------------------

def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``page_id, url, html``: a response for each payload, revisits for its repetitions."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= SMALL)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("payload_digest").alias("digest"), "first_id")
    rows = rows.join(first, F.col("payload_digest") == F.col("digest"), "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    return rows.select(F.lit(None).cast("string").alias("record_id"), kind.alias("record_type"), "page_id", "target_uri", "payload_digest", "payload_bytes", F.when(again, F.col("first_id")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def write_archive(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").option("compression", compression).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back, every stored payload checked against its digest."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", verify=True)


ORACLE_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
s as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
m as (select *, min(page_id) over (partition by payload_digest) as first_id from s)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {SMALL} and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {SMALL} and page_id <> first_id then first_id end as refers_to
from m
"""
