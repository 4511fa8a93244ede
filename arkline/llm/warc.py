"""WARC 1.1 archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own; files without compression are read too. The reader
goes through a file once: it inflates members piece by piece, takes each record's length from
its Content-Length, and checks block and payload digests while the bytes pass, so it holds one
record at most (without payloads a piece of one, and headers of up to HEADER_BYTES). Files are
the unit of parallelism; the writer starts a new one beyond ``max_bytes``.

The writer puts files where executors can all see them, under the partition's number, and
moves each into place when it is whole; a repeated task writes the same file again.

Defined results: a null payload is empty; equal payloads are one response (the rows with
the largest id; all of them, if the id repeats or is null throughout) and revisits of it;
a payload's length is that of its bytes, for a revisit the Content-Length of its HTTP headers;
control characters and blanks in a URI are percent-encoded, a null URI has no
WARC-Target-URI; a repeated row gets a record of its own. A damaged or truncated file
raises WarcError with the file's offset, or with ``mode=permissive`` ends that file with a
row whose ``error`` says so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workspace import Workspace

PIECE = 1 << 16
FILE_BYTES = 1 << 30
HEADER_BYTES = 1 << 20
_ID = "urn:arkline:record:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A file that isn't a readable archive."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(key: str, uri: str | None, payload: bytes, refers_to: str | None, date: str, level: int) -> bytes:
    """One gzip member; with refers_to a revisit record, which carries no payload."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{key}>",
        f"WARC-Date: {date}",
        *([] if uri is None else [f"WARC-Target-URI: {_uri(uri)}"]),
        *([] if refers_to is None else [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_REVISIT}"]),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "\r\n",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_length: int = 0
    digest_ok: bool = True


class _Inflated:
    """The bytes of a file's gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.read_to = stream, b"", 0
        self.start()

    def start(self) -> None:
        self.member, self.out, self.begun = zlib.decompressobj(31), b"", self.read_to - len(self.raw)

    def more(self) -> bool:
        """Inflate one piece; False at the member's end."""
        if self.member.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            self.read_to += len(self.raw)
            if not self.raw:
                raise WarcError(f"truncated member at {self.begun}")
        try:
            self.out += self.member.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise WarcError(f"damaged member at {self.begun}: {e}") from None
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if len(self.out) > most or not self.more():
                raise WarcError(f"no end of the headers at {self.begun}")
        head, self.out = self.out[:at], self.out[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise WarcError(f"the record at {self.begun} is shorter than its Content-Length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part

    def finish(self) -> bool:
        """Whether the member ends here, after the two line ends that close a record."""
        while len(self.out) <= 4 and self.more():
            pass
        return self.out == b"\r\n\r\n" and self.member.eof

    def at_end(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            self.read_to += len(self.raw)
        return not self.raw


class _Plain(_Inflated):
    """The bytes of a file without compression, one record at a time."""

    def start(self) -> None:
        self.out, self.begun = self.raw, self.read_to - len(self.raw)
        self.raw = b""

    def more(self) -> bool:
        piece = self.stream.read(PIECE)
        self.read_to += len(piece)
        self.out += piece
        return bool(piece)

    def finish(self) -> bool:
        while len(self.out) < 4 and self.more():
            pass
        ok, self.raw, self.out = self.out[:4] == b"\r\n\r\n", self.out[4:], b""
        return ok


class _Begun:
    """A stream that still has its first bytes to give."""

    def __init__(self, head: bytes, stream):
        self.head, self.stream = head, stream

    def read(self, n: int) -> bytes:
        head, self.head = self.head, b""
        return head or self.stream.read(n)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream, keep_payload: bool = True) -> Iterator[Record]:
    """The records of one archive, in order."""
    begin = stream.read(5)
    source = (_Plain if begin == b"WARC/" else _Inflated)(_Begun(begin, stream))
    while not source.at_end():
        source.start()
        head = source.until(b"\r\n\r\n", HEADER_BYTES)
        if not head.startswith(b"WARC/"):
            raise WarcError(f"no WARC record at {source.begun}")
        record = Record(source.begun, _fields(head))
        try:
            left = int(record.headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError(f"no Content-Length at {source.begun}") from None
        revisit = record.headers.get("warc-type") == "revisit"
        block, payload, parts = hashlib.sha1(), hashlib.sha1(), []
        http = bytearray() if record.headers.get("content-type", "").startswith("application/http") else None
        for part in source.take(left):
            block.update(part)
            if http is not None:
                seen = max(0, len(http) - 3)
                http += part
                if (at := http.find(b"\r\n\r\n", seen)) < 0:
                    if len(http) > HEADER_BYTES:
                        raise WarcError(f"no end of the HTTP headers at {source.begun}")
                    continue
                named = _fields(bytes(http[:at])).get("content-length", "")
                if revisit and named.isdecimal():
                    record.payload_length = int(named)
                part, http = bytes(http[at + 4 :]), None
            if not revisit:
                record.payload_length += len(part)
            payload.update(part)
            if keep_payload:
                parts.append(part)
        record.payload = b"".join(parts)
        digest = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        record.digest_ok = record.headers.get("warc-block-digest") in (None, digest(block))
        if not revisit:
            record.digest_ok &= record.headers.get("warc-payload-digest") in (None, digest(payload))
        if not source.finish():
            raise WarcError(f"the record at {source.begun} has another length than its Content-Length")
        yield record


# ---------------------------------------------------------------- Spark source and sink

_SCHEMA = "file string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, digest_ok boolean, payload binary, error string"


@dataclass
class _File(InputPartition):
    path: str


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder). Options: payload (true), mode (failfast, permissive)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader(self.options)


class _WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self):
        files, path = pafs.FileSystem.from_uri(self.path)
        found = files.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if files.get_file_info(path).type != pafs.FileType.File else [files.get_file_info(path)]
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith((".warc.gz", ".warc")) and not x.base_name.startswith(".")] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(x.split()[1], pa.string())) for n, x in zip(names, _SCHEMA.split(", "), strict=True)])
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

        bare = lambda x: x if x is None else x.strip("<>").removeprefix(_ID)
        files, _ = pafs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path, compression=None) as stream:
            try:
                for r in read_records(stream, self.payload):
                    h = r.headers
                    rows.append((partition.path, r.offset, h.get("warc-type"), bare(h.get("warc-record-id")), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, r.payload_length, r.digest_ok, r.payload if self.payload else None, None))
                    size += len(r.payload)
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield batch()
                        rows, size = [], 0
            except WarcError as e:
                if not self.permissive:
                    raise WarcError(f"{partition.path}: {e}") from None
                rows.append((partition.path, *[None] * 9, str(e)))
        if rows:
            yield batch()


def read_warc(spark: SparkSession, path: str, payload: bool = True, mode: str = "failfast") -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("mode", mode).load(path)


def plan_revisits(df: DataFrame, key_col: str, payload_col: str, min_bytes: int, space: Workspace) -> DataFrame:
    """df's key, payload and digest with _keep, the key of the response to refer to, else null.

    Only digests that repeat are kept, as a table: small ones broadcast, and with many the
    join's exchange of the payloads stands alone, so a hot digest's partition can be split.
    """
    rows = df.withColumn("_ark_payload", F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary")))
    rows = rows.withColumn("_ark_sha1", F.unhex(F.sha1("_ark_payload")))
    slim = rows.where(F.octet_length("_ark_payload") >= min_bytes).groupBy(F.col("_ark_sha1").alias("_ark_same")).agg(F.max(key_col).alias("_ark_keep"), F.count("*").alias("n"))
    shared = space.table(slim.where("n > 1").drop("n"))
    joined = rows.join(shared, F.col("_ark_sha1") == F.col("_ark_same"), "left")
    refers = F.when((F.octet_length("_ark_payload") >= min_bytes) & ~F.col(key_col).eqNullSafe(F.col("_ark_keep")), F.col("_ark_keep"))
    return joined.withColumn("_ark_refers", refers)


def write_warc(df: DataFrame, path: str, key_col: str, uri_col: str, payload_col: str, space: Workspace, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1, max_bytes: int = FILE_BYTES) -> int:
    """Writes a record for each row into folder path (a URI all executors reach); the number of records."""
    planned = plan_revisits(df, key_col, payload_col, min_bytes, space)
    text = lambda c: F.col(c).cast("string")
    rows = planned.select(text(key_col).alias("key"), text(uri_col).alias("uri"), F.col("_ark_payload").alias("payload"), text("_ark_refers").alias("refers"))

    def run(batches):
        from pyspark import TaskContext

        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        task, number, count, size, out, hidden = TaskContext.get().partitionId(), 0, 0, 0, None, ""

        def close():
            out.close()
            files.move(hidden, f"{folder}/part-{task:06d}-{number:04d}.warc.gz")

        for batch in batches:
            for key, uri, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    hidden = f"{folder}/.part-{task:06d}-{number:04d}-{uuid.uuid4().hex}"
                    out, size = files.open_output_stream(hidden, compression=None), 0
                record = encode_record("" if key is None else key, uri, payload, refers, date, level)
                out.write(record)
                size += len(record)
                count += 1
                if size >= max_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def op1(spark, sf_dir):
    space = Workspace(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    write_warc(pages, space.subdir("archive"), "page_id", "url", "html", space)
    records = read_warc(spark, space.subdir("archive"), payload=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    checked = records.where(F.when(F.col("digest_ok"), True).otherwise(F.raise_error(F.concat(F.lit("wrong digest in "), "file")).cast("boolean")))
    return checked.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


ORACLE = """
WITH raw AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
hashed AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM raw),
coded AS (SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY hex) AS keep FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to FROM coded
"""
