"""WARC archives: a writer and a PySpark Python data source.

Reading (``spark.read.format("warc")``): one partition a file.  Filters on
``record_type``, ``record_id``, ``target_uri`` and ``payload_digest`` (equality, IN)
are pushed down.  A record's header block is parsed first; if it does not pass,
its content is skipped without being decoded: by seeking in plain files, and in
compressed ones by the member's size in the gzip extra field ``sl`` (read on where
a foreign file lacks it).  With option ``payload`` = ``false`` no content is decoded.

Writing: every row is a record.  Of rows with equal payloads the one of least id is
a ``response``, the others are ``revisit`` records that refer to it and carry the
digest and length of the full payload.  Files are closed at ``FILE_BYTES`` and named
by attempt; ``_files.json`` lists those of the tasks that counted.

Defined results: a null payload is empty; rows that repeat the least id and its
payload are all responses; a null id is a record named ``null`` that refers to the
least non-null id, if there is one; empty tables give an empty archive; a record
whose payload does not match its digest raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import materialise, new_folder, open_fs
from .near_dedup import small

FILE_BYTES = 64 << 20
LEVEL = 4
NAME = "urn:geoloom:page:"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, headers map<string,string>, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: pushed column -> header name
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}


def base32(digest: bytes) -> str:
    """Upper-case base32 of a SHA-1 digest (twenty bytes need no padding)."""
    return base64.b32encode(digest).decode()


def record(headers: dict[str, str], content: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(content))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + content + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with its compressed and plain sizes in the extra field ``sl``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            last = key.strip().lower()
            out[last] = value.strip()
    return out


def _plain_records(source, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """Records of an uncompressed file; content is read only if ``wanted(headers)`` says so."""
    size = source.size()
    at = 0
    while at < size:
        source.seek(at)
        block = b""
        while b"\r\n\r\n" not in block:
            more = source.read(4096)
            if not more:
                if block.strip():
                    raise ValueError("the archive ends inside a header")
                return
            block += more
            if not block.lstrip(b"\r\n"):
                block = b""
                at = source.tell()
        lead = len(block) - len(block.lstrip(b"\r\n"))
        end = block.index(b"\r\n\r\n", lead)
        headers = _headers(block[lead:end])
        start, length = at + end + 4, int(headers.get("content-length", "0"))
        answer = wanted(headers)
        if answer is not None:
            content = None
            if answer:
                source.seek(start)
                content = source.read(length)
                if len(content) < length:
                    raise ValueError("the archive ends inside a record")
            yield headers, content
        at = start + length + 4


def _zipped_records(source, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """Records of a file of gzip members, one record each."""
    size, at = source.size(), 0
    while at < size:
        source.seek(at)
        head = source.read(24)
        known = struct.unpack("<I", head[16:20])[0] if head[3] == 4 and head[12:14] == b"sl" else 0
        source.seek(at)
        inflate = zlib.decompressobj(31)
        first = source.read(min(known, 2048) if known else 65536)
        taken = len(first)
        plain = inflate.decompress(first, 8192)
        while b"\r\n\r\n" not in plain:
            rest = inflate.unconsumed_tail
            if not rest and not inflate.eof:
                rest = source.read(65536)
                taken += len(rest)
                if not rest:
                    raise ValueError("the archive ends inside a header")
            if inflate.eof:
                raise ValueError("a member without a header")
            plain += inflate.decompress(rest, 8192)
        end = plain.index(b"\r\n\r\n")
        headers = _headers(plain[:end])
        answer = wanted(headers)
        content = None
        if answer or not known:
            parts, pending = [plain[end + 4 :]], inflate.unconsumed_tail
            while not inflate.eof:
                if not pending:
                    pending = source.read(min(1 << 16, known - taken) if known else 1 << 16)
                    taken += len(pending)
                    if not pending:
                        raise ValueError("the archive ends inside a record")
                parts.append(inflate.decompress(pending))
                pending = b""
            if answer:
                content = b"".join(parts)[: int(headers.get("content-length", "0"))]
            at += known or taken - len(inflate.unused_data)
        else:
            at += known
        if answer is not None:
            yield headers, content


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = PUSHED.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            else:
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))

    def partitions(self) -> list[WarcFile]:
        files, inner = open_fs(self.path)
        from pyarrow import fs

        if files.get_file_info(inner).type == fs.FileType.File:
            return [WarcFile(self.path)]
        listing = f"{inner}/_files.json"
        if files.get_file_info(listing).type == fs.FileType.File:
            with files.open_input_stream(listing) as source:
                names = json.loads(source.read())
        else:
            found = files.get_file_info(fs.FileSelector(inner))
            names = sorted(x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz")))
        return [WarcFile(f"{self.path.rstrip('/')}/{n}") for n in names]

    def _wanted(self, headers: dict) -> bool | None:
        """None: not asked for; otherwise whether to decode the content."""
        for name, values in self.tests:
            if _value(name, headers.get(name)) not in values:
                return None
        return self.payload

    def read(self, partition: WarcFile | None) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        rows, size = [], 0
        if partition is None:  # an archive without files
            return
        files, inner = open_fs(partition.path)
        with files.open_input_file(inner) as source:
            records = _zipped_records if inner.endswith(".gz") else _plain_records
            for headers, content in records(source, self._wanted):
                rows.append(_row(headers, content))
                size += len(content or b"")
                if len(rows) >= 5000 or size > 4 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _value(name: str, value: str | None) -> str | None:
    """A header's value as the columns give it."""
    if value is None:
        return None
    return value.removeprefix("sha1:") if name == "warc-payload-digest" else value.strip("<>")


def _row(headers: dict, content: bytes | None) -> tuple:
    kind, digest = headers.get("warc-type"), _value("warc-payload-digest", headers.get("warc-payload-digest"))
    payload, length = content, headers.get("x-payload-length")
    if content is not None and headers.get("content-type", "").startswith("application/http"):
        payload = content.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in content else b""
    if kind == "revisit":
        payload = None
    elif payload is not None:
        length = len(payload)
        if digest and headers.get("warc-payload-digest", "").startswith("sha1:") and base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"payload digest of {headers.get('warc-record-id')}")
    size = None if length is None else int(length)
    return (_value("", headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), _value("", headers.get("warc-refers-to")), digest, size, list(headers.items()), payload)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark, path: str, payload: bool = True) -> DataFrame:
    """Records below ``path``; filters on the result's header columns reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(rows: DataFrame, folder: str, compressed: bool = True, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> int:
    """Write rows (id long, url string, payload binary) as an archive below ``folder``; returns the number of files."""
    spark = rows.sparkSession
    own = rows.select(F.col("id").cast("long").alias("id"), "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    # digests that several rows share, whatever their number, are one row each
    heads = own.groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    heads = materialise(heads, "digests")
    joined = own.join(small(heads), "digest", "left").withColumn("refers", F.when(~F.col("id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.col("head")))
    suffix = ".warc.gz" if compressed else ".warc"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        files, inner = open_fs(folder)
        files.create_dir(inner, recursive=True)
        part, names, sink, size = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or size > file_bytes:
                    if sink is not None:
                        sink.close()
                    names.append(f"part-{part:06d}-{uuid.uuid4().hex}{suffix}")
                    sink, size = files.open_output_stream(f"{inner}/{names[-1]}", compression=None), 0
                headers = {
                    "WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": f"<{NAME}{'null' if key is None else key}>", "WARC-Date": date,
                    "WARC-Payload-Digest": "sha1:" + base32(bytes.fromhex(digest)), "Content-Type": "application/http; msgtype=response", "X-Payload-Length": str(len(payload)),
                }
                if url:
                    headers["WARC-Target-URI"] = "".join(url.splitlines())
                if refers is not None:
                    headers |= {"WARC-Refers-To": f"<{NAME}{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                data = record(headers, HTTP + payload if refers is None else HTTP)
                data = member(data) if compressed else data
                sink.write(data)
                size += len(data)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    written = joined.select("id", "url", "payload", "digest", "refers").mapInArrow(run, "file string")
    names = sorted(r["file"] for r in materialise(written, "warc-files").collect())  # one row a file
    files, inner = open_fs(folder)
    files.create_dir(inner, recursive=True)
    with files.open_output_stream(f"{inner}/_files.json") as sink:
        sink.write(json.dumps(names).encode())
    return len(names)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every page through an archive and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    write_warc(pages.select(F.col("page_id").alias("id"), "url", F.encode("html", "UTF-8").alias("payload")), folder)
    back = read_warc(spark, folder)

    def number(column: str):
        return F.regexp_extract(column, f"^{NAME}(-?[0-9]+)$", 1).try_cast("long")

    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
