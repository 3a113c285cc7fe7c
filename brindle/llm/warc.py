"""WARC archives as a Spark data source (``spark.read.format("warc")``, ``df.write.format("warc")``).

Reading: files are planned into partitions by size. Predicates on record type and header fields are taken over
from Spark. A record's head is parsed first; its block is inflated only where the record passes and the
asked-for schema has a column that needs it. Otherwise the reader seeks past it: the writer notes each
gzip member's length in the extra field ``LX``. Members of other writers are inflated and thrown away.

Writing: a task writes files of at most ``file_bytes`` under hidden names; the driver renames them when every
task has ended, so lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import LongType, StructType

from brindle.scratch import qualified

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, content_type string, "
    "payload_digest string, content_length long, payload_bytes long, payload binary"
)
#: Columns that a record's head gives, and the header each stands in.
HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "content_length": "content-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EXTRA = b"LX"
_UNSAFE = re.compile(r"[\x00-\x1f\x7f]")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 8) + EXTRA + struct.pack("<HI", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """A response record with its payload behind an HTTP head, or a revisit record with the head alone."""
    payload = row["payload"] or b""
    full, sha = (len(payload), digest(payload)) if row["warc_type"] != "revisit" else (row["payload_bytes"], row["payload_digest"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block = http + (b"" if row["warc_type"] == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{_safe(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_safe(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if row["warc_type"] == "revisit":
        head += [f"WARC-Refers-To: <{_safe(row['refers_to'])}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """For paths with a scheme: the source's tasks and planner do not know the cluster's default file system."""
    if ":/" not in path:
        raise ValueError(f"give the archives' path with its scheme (scratch.qualified adds it): {path}")
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    """(path, bytes) of the files a task reads."""

    files: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Members:
    """Records of one archive, gzipped by member or plain: the head of each, then its block if asked for."""

    STEP = 1 << 16

    def __init__(self, f):
        self.f, self.zipped = f, f.read(2) == b"\x1f\x8b"
        f.seek(0)

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        at, size = 0, self.f.size()
        while at < size:
            self.f.seek(at)
            source, after = self._open(at)
            raw, head = b"", -1
            while (head := raw.find(b"\r\n\r\n")) < 0 and (more := source(self.STEP)):
                raw += more
            if head < 0:
                if raw.strip():
                    raise ValueError(f"no record head at byte {at}")
                break
            lines = raw[:head].decode("utf-8", "replace").strip().split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length, rest = int(fields.get("content-length", 0)), raw[head + 4 :]

            def block(rest=rest, length=length, source=source) -> bytes:
                parts, n = [rest], len(rest)
                while n < length and (more := source(self.STEP)):
                    parts.append(more)
                    n += len(more)
                if n < length:
                    raise ValueError("a record is cut short")
                return b"".join(parts)[:length]

            yield fields, block
            at = after(head + 4 + length)

    def _open(self, at: int):
        """Reads on from a record's start, and where the next record starts given this one's length."""
        if not self.zipped:
            return self.f.read, lambda length: at + length + 4
        head = self.f.read(12)
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        known = 0
        if head[3] & 4:
            extra = self.f.read(struct.unpack("<H", head[10:12])[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == EXTRA and n == 4:
                    known = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        self.f.seek(at)
        z = zlib.decompressobj(31)

        def source(n: int) -> bytes:
            data = z.unconsumed_tail or self.f.read(self.STEP)
            out = z.decompress(data, n)
            while not out and not z.eof and (data := z.unconsumed_tail or self.f.read(self.STEP)):
                out = z.decompress(data, n)
            return out

        def after(_: int) -> int:
            if known:
                return at + known
            while not z.eof and source(1 << 20):
                pass
            return self.f.tell() - len(z.unused_data) if z.eof else self.f.size()

        return source, after


def _passes(f: Filter, value: object) -> bool:
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in value


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[:1] == "<" and value[-1:] == ">" else value


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            simple = isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains))
            if name in HEADERS and simple:
                self.filters.append((name, f))
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        where, path = place(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        found = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and "/." not in x.path)
        out, room = [], 0
        for item in found:
            if not out or item[1] > room:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].files.append(item)
            room -= item[1]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = place(self.path)
        names = self.schema.names
        wants = {"payload", "payload_bytes"} & set(names)
        for path, _ in partition.files:
            with where.open_input_file(path) as f:
                for fields, block in Members(f):
                    row = {c: fields.get(h) for c, h in HEADERS.items()}
                    row["record_id"], row["refers_to"] = _bare(row["record_id"]), _bare(row["refers_to"])
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    row["content_length"] = int(row["content_length"] or 0)
                    if all(_passes(x, row[c]) for c, x in self.filters):
                        if wants:
                            row |= self._payload(row, block())
                        yield tuple(row.get(c) for c in names)

    @staticmethod
    def _payload(row: dict, block: bytes) -> dict:
        """What follows the HTTP head, or the whole block where there is none; a revisit's length is the original's."""
        if not (row["content_type"] or "").startswith("application/http"):
            return {"payload": block, "payload_bytes": len(block)}
        head, _, payload = block.partition(b"\r\n\r\n")
        if row["warc_type"] != "revisit":
            return {"payload": payload, "payload_bytes": len(payload)}
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return {"payload": None, "payload_bytes": int(told[1]) if told else None}


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, file_bytes: int):
        self.path, self.date, self.file_bytes = path, date, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        files: list[str] = []
        out, room = None, 0
        try:
            for batch in iterator:
                for at in range(0, len(batch), 100):
                    for row in batch.slice(at, 100).to_pylist():
                        if out is None or room <= 0:
                            if out:
                                out.close()
                            files.append(f".{uuid.uuid4().hex}.warc.gz")
                            out, room = where.open_output_stream(f"{root}/{files[-1]}", compression=None), self.file_bytes
                        data = member(record(row, self.date))
                        out.write(data)
                        room -= len(data)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        for name in (n for m in messages if m for n in m.files):
            where.move(f"{root}/{name}", f"{root}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = place(self.path)
        for name in (n for m in messages if m for n in m.files):
            where.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; reading: partition_bytes; writing: date (WARC-Date of every record; by default when the writing
    was planned), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode append")
        return WarcWriter(self.options["path"], self.options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), int(self.options.get("file_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to the session and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(made: DataFrame, path: str, **options: str) -> None:
    """Adds the archives of ``records`` to a folder; a path without a scheme is in the default file system."""
    made.write.format("warc").mode("append").options(**options).save(qualified(made.sparkSession, path))


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records below a folder; a path without a scheme is in the default file system."""
    return spark.read.format("warc").options(**options).load(qualified(spark, path))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """A record per page, its payload the html in UTF-8 (null: empty). No pages give no records.

    Of the pages with equal payloads of ``least_bytes`` or more, that with the largest key is the response and the
    others, also those with a null key, revisit it; rows that share the largest key are all responses, as are
    all rows where no key is known. Payloads are told apart by SHA-256 and length; the SHA-1 is the header's alone.

    A record's id names its page and numbers the row, so rows with equal and null keys have ids of their own; a revisit
    refers to one response's. The table must read alike each time (files, or stored first). A payload's rows are only
    brought to its response by a join, which adaptive execution splits where one payload is very common.
    """
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(key).cast("long").cast("string"), F.lit("none")), F.lit("-"), F.monotonically_increasing_id().cast("string"))
    p = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("target_uri"), body.alias("payload"), name.alias("record_id"))
    p = p.withColumns({"sha": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    # Nulls are the least of keys, so the response has one if any row does.
    top = p.groupBy("sha", "n").agg(F.max(F.struct("k", "record_id")).alias("top")).select(F.col("sha").alias("sha_"), F.col("n").alias("n_"), "top")
    # Only the digest is a key: a join on both columns would reuse the aggregate's partitioning, which cannot be split.
    all_ = p.join(top, (F.col("sha") == F.col("sha_")) & (F.col("n") <= F.col("n_")) & (F.col("n") >= F.col("n_")), "inner")
    again = F.col("top.k").isNotNull() & ~F.col("k").eqNullSafe(F.col("top.k")) & (F.col("n") >= least_bytes)
    return all_.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        "record_id",
        "target_uri",
        F.when(again, F.col("top.record_id")).alias("refers_to"),
        base32(F.sha1("payload")).alias("payload_digest"),
        F.col("n").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hex digits: every five hex digits are four base32 digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = [F.conv(F.substring(sha1_hex, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*(F.substr(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in five for s in (15, 10, 5, 0)))


def page_key(name: str) -> Column:
    """The key in a record id of ``records``; null where it has none."""
    return F.nullif(F.regexp_extract(F.col(name), r"^urn:x-page:(-?\d+)-\d+$", 1), F.lit("")).cast(LongType())
