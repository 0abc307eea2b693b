"""Archives of pages: many documents a file, in the WARC format (ISO 28500).

``spark.read.format("page_archive")`` after ``register(spark)``. A task reads the records that
begin in its range of a file. Record bodies may hold anything, also what looks like a
record's beginning, so a task finds its first record by going from length to length
from the file's start, without reading the bodies. Files that end in .gz are compressed
record by record and are read by one task each.

``response`` and ``resource`` records are pages, all others are left out. A page's bytes become text by the
byte-order mark, else the charset of the answer's content type, else that of a meta element
within the first 1,024 bytes, else as UTF-8 if they are that, else as windows-1252. Bytes
that stand for no character become U+FFFD. A record that is cut short ends its file: it and
what follows are left out, unless ``failOnCut`` is true (the default), which fails the read.
"""

from __future__ import annotations

import codecs
import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "page_archive"
SCHEMA = "record_id string, url string, status_code int, content_type string, html string, file string, place long"
RANGE = 128 << 20
BATCH = 8 << 20
BUFFER = 1 << 16

# Fixed values of the format, and names of charsets that web pages use for another one.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
SYNONYMS = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932"}
META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)


def _codec(label: str | None) -> str | None:
    try:
        name = codecs.lookup(label).name if label else None
        # Codecs that are not for text, such as hex, cannot decode a page.
        if name is None or not codecs.lookup(name)._is_text_encoding:
            return None
    except LookupError:
        return None
    return SYNONYMS.get(name, name)


def decoded(body: bytes, content_type: str | None) -> str:
    """The text of a page's bytes."""
    for mark, codec in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(codec, "replace")
    named = CHARSET.search(content_type or "")
    codec = _codec(named[1] if named else None)
    if codec is None:
        inside = META.search(body, 0, 1024)
        codec = _codec(inside[1].decode("ascii") if inside else None)
        # A meta element that could be read as bytes cannot be in UTF-16.
        codec = "utf-8" if codec and codec.startswith("utf-16") else codec
    if codec is None:
        try:
            return body.decode("utf-8")
        except UnicodeDecodeError:
            codec = "cp1252"
    return body.decode(codec, "replace")


def _fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


class _Cut(Exception):
    """A record that the file does not hold to its end."""


def _head(file: BinaryIO) -> dict[str, str] | None:
    """The fields of the record that begins here; None at the end of the file."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise _Cut("no record begins here")
    lines = []
    while (line := file.readline()).strip():
        lines.append(line)
    fields = _fields(lines)
    if not line or not fields.get("content-length", "").isdigit():
        raise _Cut("the record's head is cut short")
    return fields


def _answer(block: bytes) -> tuple[int | None, str | None, bytes]:
    """Status, content type and body of an HTTP answer."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    status = re.match(rb"HTTP/\S+ +([0-9]{3})\b", lines[0])
    fields = _fields(lines[1:])
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip") and body[:2] == b"\x1f\x8b":
        body = zlib.decompressobj(31).decompress(body)
    return int(status[1]) if status else None, fields.get("content-type"), body


def records(file: BinaryIO, start: int, end: int | None) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the pages that begin in [start, end)."""
    while True:
        place = file.tell()
        if end is not None and place >= end:
            return
        fields = _head(file)
        if fields is None:
            return
        length = int(fields["content-length"])
        if place < start or fields.get("warc-type") not in ("response", "resource"):
            file.seek(length, 1)
            continue
        block = file.read(length)
        if len(block) < length:
            raise _Cut("the record is cut short")
        yield place, fields, block


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.strict = options.get("failOnCut", "true").lower() == "true"
        self.range = int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[_Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            hidden = any(part.startswith(("_", ".")) for part in f.path[len(root) :].split("/") if part)
            if f.type != fs.FileType.File or hidden or not f.size:
                continue
            if f.path.endswith(".gz"):
                out.append(_Range(f.path, 0, None))
            else:
                out.extend(_Range(f.path, at, at + self.range) for at in range(0, f.size, self.range))
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema(
            [("record_id", pa.string()), ("url", pa.string()), ("status_code", pa.int32()), ("content_type", pa.string())]
            + [("html", pa.string()), ("file", pa.string()), ("place", pa.int64())]
        )
        rows: list[tuple] = []
        size = 0
        with store.open_input_file(partition.path) as raw:
            file = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, BUFFER)
            try:
                for place, fields, block in records(file, partition.start, partition.end):
                    if fields["warc-type"] == "response":
                        status, kind, body = _answer(block)
                    else:
                        status, kind, body = None, fields.get("content-type"), block
                    url = fields.get("warc-target-uri")
                    rows.append((fields.get("warc-record-id"), url, status, kind, decoded(body, kind), partition.path, place))
                    size += len(block)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
            except (_Cut, EOFError) as cut:
                if self.strict:
                    raise ValueError(f"{partition.path}: {cut}") from cut
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """One file a task, under a hidden name until all tasks are done; tasks that run twice
    leave a hidden file, never a page twice."""

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        missing = {"record_id", "url", "html"} - set(columns)
        if missing:
            raise ValueError(f"pages for an archive need the columns {sorted(missing)}")
        if overwrite:
            raise ValueError("archives are only added to")
        self.path, self.charset = options["path"], "charset" in columns
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)

    def write(self, rows: Iterator[Row]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.path)
        name = f"part-{uuid.uuid4().hex}.warc"
        with store.open_output_stream(f"{root}/.{name}") as out:
            for row in rows:
                charset = (row["charset"] if self.charset else None) or "utf-8"
                body = (row["html"] or "").encode(charset, "xmlcharrefreplace")
                kind = f"text/html; charset={charset}"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
                head = (("WARC-Type", "response"), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row["url"]))
                # A field is one line.
                lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head if v is not None]
                out.write(f"WARC/1.0\r\n{''.join(lines)}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None:
                store.move(f"{root}/.{message.name}", f"{root}/{message.name}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None:
                store.delete_file(f"{root}/.{message.name}")


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageArchive)


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The pages of all archives below ``path``: (record_id, url, status_code, content_type,
    html, file, place). ``path`` is absolute or a URI; ``rangeBytes`` is the size of a task's range."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def write_archives(pages: DataFrame, path: str) -> None:
    """(record_id, url, html) and, if there, charset as archives, one file a partition, added to
    ``path``. A null page is an empty document; characters that a charset lacks become references."""
    register(pages.sparkSession)
    pages.write.format(FORMAT).mode("append").save(path)
