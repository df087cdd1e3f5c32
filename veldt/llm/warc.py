"""WARC archives as a Spark data source, in Python.

``spark.read.format("warc")`` plans one partition for each group of archive files of about
``partition_bytes``. Predicates on record_type and on the other header columns are pushed
into the reader: it parses a record's header first, and where the header fails, or the
query doesn't use the payload (option payload=false), it steps over the record's block
without reading it. ``df.write.format("warc")`` writes archives that are rolled at
``archive_bytes``; they count once the writer has put them into the manifest, so what a
lost or repeated task leaves behind isn't read. A folder without a manifest, a single file
or a pattern is read as it is: all files that end in .warc or .warc.gz. A file that ends
within a record raises.

Files are reached by pyarrow's file systems, from the path's scheme.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import one_row_an_id, shared_dir, stored

ARCHIVE_BYTES = 256 << 20
PARTITION_BYTES = 128 << 20
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, profile string, content_type string, payload binary"
_HEADERS = {
    "record_type": b"WARC-Type",
    "record_id": b"WARC-Record-ID",
    "target_uri": b"WARC-Target-URI",
    "date": b"WARC-Date",
    "payload_digest": b"WARC-Payload-Digest",
    "payload_length": b"WARC-Payload-Length",
    "refers_to": b"WARC-Refers-To",
    "profile": b"WARC-Profile",
    "content_type": b"Content-Type",
}
_COLUMN = {name.lower(): column for column, name in _HEADERS.items()}
_MANIFEST = "_archives.json"
_ENDINGS = (".warc", ".warc.gz")
#: Of revisits whose payload is that of the record they refer to (fixed by the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records ---


def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record. Line breaks in header values become blanks; nulls are left out."""
    payload = row.get("payload") or b""
    lines = [b"WARC/1.1"]
    for column, name in _HEADERS.items():
        value = row.get(column)
        if value is not None:
            lines.append(name + b": " + b" ".join(str(value).encode().split(b"\n")).replace(b"\r", b" "))
    lines.append(b"Content-Length: %d" % len(payload))
    return b"\r\n".join(lines) + b"\r\n\r\n" + bytes(payload) + b"\r\n\r\n"


def _header(stream) -> tuple[dict, int] | None:
    """Columns and block length of the record that begins here; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict = dict.fromkeys(_HEADERS)
    length = None
    while (line := stream.readline()).rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        name, value = name.strip().lower(), value.strip()
        if name == b"content-length":
            length = int(value)
        elif name in _COLUMN:
            out[_COLUMN[name]] = value.decode("utf-8", "replace")
    if not line or length is None:
        raise ValueError("the archive ends within a header" if not line else "a record has no Content-Length")
    if out["payload_length"] is not None:
        out["payload_length"] = int(out["payload_length"])
    return out, length


def _holds(f: Filter, row: dict) -> bool:
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    ordered = {EqualTo: value == f.value} if isinstance(f, EqualTo) else {GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}
    return ordered[type(f)]


_PUSHED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)


# ----------------------------------------------------------------- source ---


@dataclass
class Archives(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, _PUSHED) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def _files(self) -> list[dict]:
        """Paths of the archives, and their sizes."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        if any(c in root for c in "*?["):
            folder = root[: min(root.index(c) for c in "*?[" if c in root)].rpartition("/")[0]
            return [f for f in self._listed(fs, folder) if fnmatchcase(f["path"], root)]
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [{"path": root, "bytes": info.size}]
        if fs.get_file_info(f"{root}/{_MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{_MANIFEST}") as s:
                return [f | {"path": f"{root}/{f['path']}"} for f in json.loads(s.read())]
        return [f for f in self._listed(fs, root) if f["path"].endswith(_ENDINGS)]

    @staticmethod
    def _listed(fs: pafs.FileSystem, folder: str) -> list[dict]:
        return [{"path": f.path, "bytes": f.size} for f in fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if f.type == pafs.FileType.File]

    def partitions(self) -> list[InputPartition]:
        out: list[list[str]] = []
        room = 0
        for f in sorted(self._files(), key=lambda f: f["path"]):
            if f["bytes"] > room or not out:
                out.append([])
                room = self.bytes
            out[-1].append(f["path"])
            room -= f["bytes"]
        return [Archives(p) for p in out] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                yield from self._records(_Buffered(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, None if path.endswith(".gz") else raw.size()))

    def _records(self, stream: _Buffered) -> Iterator[tuple]:
        while (head := _header(stream)) is not None:
            row, length = head
            if all(_holds(f, row) for f in self.filters):
                payload = stream.read(length) if self.payload else stream.skip(length)
                yield (*row.values(), payload)
            else:
                stream.skip(length)


class _Buffered:
    """Lines and blocks of a file, by pieces of at most a megabyte. size: of the file, whose
    blocks can then be stepped over; without it they are read and let go."""

    PIECE = 1 << 20

    def __init__(self, raw, size: int | None = None):
        self.raw, self.size, self.held, self.at = raw, size, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(self.PIECE)
        self.held, self.at = self.held[self.at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.held) - 1
                break
        line = self.held[self.at : end + 1]
        self.at = end + 1
        return line

    def read(self, n: int) -> bytes:
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        if len(out) < n:
            out += self.raw.read(n - len(out))
        if len(out) < n:
            raise ValueError(f"the archive ends {n - len(out)} bytes ahead of a record's end")
        return out

    def skip(self, n: int) -> None:
        have = min(n, len(self.held) - self.at)
        self.at += have
        n -= have
        if n and self.size is not None:
            if self.raw.tell() + n > self.size:
                raise ValueError(f"the archive ends {self.raw.tell() + n - self.size} bytes ahead of a record's end")
            self.raw.seek(self.raw.tell() + n)
            return
        while n:
            n -= len(self.read(min(n, self.PIECE)))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))
        self.names = schema.names

    def write(self, iterator: Iterator) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files: list[dict] = []
        out = None
        for row in iterator:
            record = record_bytes(dict(zip(self.names, row, strict=True)))
            if out is None:
                files.append({"path": f"part-{uuid.uuid4().hex}.warc", "bytes": 0})
                out = fs.open_output_stream(f"{root}/{files[-1]['path']}")
            out.write(record)
            files[-1]["bytes"] += len(record)
            if files[-1]["bytes"] >= self.bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{_MANIFEST}") as s:
            s.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f['path']}")


class WarcSource(DataSource):
    """Options: path; payload (read: false gives nulls and steps over the blocks);
    partition_bytes (read); archive_bytes (write)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --------------------------------------------------------------- archiving ---

_PREFIX = "urn:page:"


def _urn(page_id):
    return F.concat(F.lit(f"<{_PREFIX}"), page_id.cast("string"), F.lit(">"))


def page_of(urn):
    return F.regexp_extract(urn, rf"^<{_PREFIX}(-?[0-9]+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date_col: str | None = None) -> None:
    """Write a record for each page to archives under path. date_col: a column with the pages'
    WARC-Date; without one all have the time of writing.

    The payload is the html in UTF-8, a null one is empty. Of the pages with equal payloads
    of at least revisit_bytes bytes, that with the largest id is a response, the others are
    revisits of it, with digest and length of the full payload but no block; all smaller ones
    are responses. Rows whose id is null are left out; of rows that share an id the one with
    the least url, then payload, is written; null urls are left out of the header; other columns are ignored. An empty table gives no archives.

    Only the digests are compared in a shuffle, not the payloads: one row goes out for each
    digest and task, so a payload that a third of all pages share weighs no more than others.
    """
    page = one_row_an_id(pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"), (F.col(date_col).cast("string") if date_col else F.lit(None).cast("string")).alias("date")).where("page is not null"), "page")
    page = page.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    large = page.where(F.col("bytes") >= revisit_bytes).select("page", "digest", "bytes")
    shared = large.groupBy("digest", "bytes").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits, _ = stored(large.join(shared, ["digest", "bytes"]).where("page <> first").select("page", "first"), "revisits")
    whole = page.join(revisits, "page", "left")
    again = F.col("first").isNotNull()
    records = whole.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("page")).alias("record_id"),
        F.col("url").alias("target_uri"),
        (F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col is None else F.col("date")).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_length"),
        F.when(again, _urn(F.col("first"))).alias("refers_to"),
        F.when(again, SAME_PAYLOAD).alias("profile"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").option("path", path).save()


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Of responses, length and digest are those of the payload that was read; of
    revisits, whose blocks aren't read, those of the header."""
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(path)
    full = read("true").where("record_type = 'response'").select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    short = read("false").where("record_type = 'revisit'").select(
        page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to")
    )
    return full.unionByName(short)


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veldt-warc-{uuid.uuid4().hex[:12]}"
