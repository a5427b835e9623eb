"""WARC records in ZIP packages: stored members found by the central directory and read by range, without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdx`` (a line a record: its
offset, its length and its type), both stored, not compressed again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedge.llm.work import fields, give_back, new_path, table, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of payload after which a task starts another package, and tasks that read packages, at most.
PACKAGE, READERS = 32 << 20, 10_000
#: A fixed date: a record is a function of its page alone.
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


class ZipPackage:
    """The stored members of a ZIP archive behind any seekable file.

    The end record gives the central directory; where its fields are full the ZIP64 end record does. Members
    that are compressed or encrypted are listed but can't be read. Raises ValueError for what is no archive.
    """

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - (1 << 16) - 22)
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self._read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if locator[:4] == _LOCATOR:
                end = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != _END64:
                    raise ValueError("no ZIP64 end of central directory")
                count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, p = self._read(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != _ENTRY:
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, full, n, extra, note = struct.unpack_from("<IIHHH", directory, p + 20)
            offset = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            field, end = p + 46 + n, p + 46 + n + extra
            while field + 4 <= end:
                kind, width = struct.unpack_from("<HH", directory, field)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{width // 8}Q", directory, field + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                field += 4 + width
            self.members[name] = (offset, packed, -1 if flags & 1 else method)
            p = end + note

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def start(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many they are."""
        offset, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored")
        local = self._read(offset, 30)
        if local[:4] != _LOCAL:
            raise ValueError("bad local header")
        n, extra = struct.unpack_from("<HH", local, 26)
        return offset + 30 + n + extra, size

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        first, size = self.start(name)
        n = size - at if n is None else n
        if at < 0 or n < 0 or at + n > size:
            raise ValueError("range outside the member")
        return self._read(first + at, n)


def _header(*lines: tuple[str, object]) -> bytes:
    clean = [(k, re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))) for k, v in lines if v is not None]
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in clean)


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """A response, or a revisit of page ``refers_to``, as one gzip member. A revisit keeps the HTTP header, with
    the length of the full payload, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\n" + _header(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    block = http if refers_to is not None else http + payload
    head = b"WARC/1.1\r\n" + _header(
        ("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT if refers_to is not None else None), ("WARC-Refers-To", f"<urn:page:{refers_to}>" if refers_to is not None else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    )
    return gzip.compress(head + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields (lower case), HTTP header and payload of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def package(records: list[tuple[bytes, str]], zip64: bool = False) -> bytes:
    """A ZIP package of gzip members and their types."""
    index, at = [], 0
    for data, kind in records:
        index.append(f"{at} {len(data)} {kind}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((DATA, (d for d, _ in records)), (INDEX, (x.encode() for x in index))):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            with z.open(info, "w", force_zip64=zip64) as f:
                for x in parts:
                    f.write(x)
    return out.getvalue()


#: What Hadoop calls an object store, and what Arrow calls it.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "file": "file", "hdfs": "hdfs", "s3": "s3", "gs": "gs", "abfs": "abfs"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, as Spark spells them, and the path in it."""
    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme not in SCHEMES:
        raise ValueError(f"no file system for {scheme}:")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to) as packages under ``folder``, a URI that every executor reaches.

    A row per package: path, records. Names hold a fresh id for each attempt of a task, so a lost or doubled
    attempt leaves a file that no manifest names and never a mixed one.
    """

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        done, own, size = [], [], 0
        stem = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"

        def flush():
            path = f"{stem}-{len(done):04d}.wacz"
            with fs.open_output_stream(path) as f:
                f.write(package(own))
            done.append((path, len(own)))

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                page, payload, refers = page.as_py(), payload.as_py(), refers.as_py()
                own.append((record(page, url.as_py(), payload, base32_sha1(payload), refers), "revisit" if refers is not None else "response"))
                size += len(payload)
                if size >= PACKAGE:
                    flush()
                    own, size = [], 0
        if own:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long")


def read_packages(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the packages a manifest names: page, url, payload_bytes, payload_digest, record_type,
    refers_to, path, offset, length, and with ``payloads`` payload (null for a revisit).

    Records are found by the index and read by range, a package at a time. A response whose payload doesn't have
    the digest of its header, or a revisit with a payload, raises ValueError.
    """
    schema = fields(page="string", url="string", payload_bytes="long", payload_digest="string", record_type="string", refers_to="string", path="string", offset="long", length="long", payload="binary")
    names = schema.names

    def records(fs, path):
        with fs.open_input_file(path) as f:
            z = ZipPackage(f, f.size())
            for line in z.read(INDEX).decode().splitlines():
                at, n, kind = line.split()
                head, http, payload = parse_record(z.read(DATA, int(at), int(n)))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                full = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
                if kind != head["warc-type"] or (kind == "response" and (full != len(payload) or base32_sha1(payload) != digest)) or (kind == "revisit" and payload):
                    raise ValueError(f"damaged record at {at} in {path}")
                page = head["warc-record-id"][len("<urn:page:") : -1]
                refers = head["warc-refers-to"][len("<urn:page:") : -1] if kind == "revisit" else None
                yield page or None, head.get("warc-target-uri"), full, digest, kind, refers, path, int(at), int(n), payload if payloads and kind == "response" else None

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(records(fs, path))
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        give_back()

    arrow = to_arrow_schema(schema)
    found = manifest.select("path").mapInArrow(run, schema)
    return found if payloads else found.select(*names[:-1])


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages written as WARC packages and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Of the pages of one payload that of the least page_id is a response and the others revisit it; a null html
    is an empty payload and takes part. Rows of the least page_id itself are all responses; a page of null id
    revisits the least id that is not null, if there is one. An empty table gives no rows. Only page_id, url
    and html are read.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_digest", F.sha1("payload"))
    # Written, so that its size is known and that the join of two shuffles can split a payload of very many pages.
    copies = written(rows.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "warc-copies")
    marked = rows.join(copies, "_digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("_first")), F.lit(None)).otherwise(F.col("_first")))
    folder = new_path(spark, "warc")
    manifest = written(write_packages(marked, folder), "warc-manifest")
    spread = manifest.repartition(max(1, min(manifest.count(), READERS)))
    kind = pages.schema["page_id"].dataType
    return read_packages(spread, folder).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
d AS (SELECT page_id, url, payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url
FROM d
"""
