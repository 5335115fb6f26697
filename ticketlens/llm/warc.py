"""WARC archives as a Spark data source, and the writing of pages with revisit records for equal payloads.

A record is one gzip member. Its gzip header has the length of the whole member in an extra field, so a reader that
does not want a record leaps over it after its header lines. Plain files and members without that field are read too.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage,
)

from ticketlens.llm import textops as tx
from ticketlens.session import scratch_path, stage_table

FORMAT = "warc_archive"
# A file of an archive is closed beyond so many bytes; smaller files are read together up to so many.
FILE_BYTES = 64 << 20
MANIFEST = "_archive.json"
DATE = "1970-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SKIP = b"sl"

# Columns of a read. The header columns come from header lines; payload is null for records that have none.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload_length long, payload binary"
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_length", "payload")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all executors reach, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]+://", path, re.I):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


# ---- records -------------------------------------------------------------------------------------


def record(row: dict[str, Any]) -> bytes:
    """A record of a page: an HTTP response with the payload, or without it for a revisit."""
    payload = row["payload"] if row["record_type"] != "revisit" and row["payload"] is not None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    lines = {h: row.get(c) for c, h in HEADERS.items()} | {"Content-Type": "application/http; msgtype=response"}
    lines["WARC-Payload-Digest"] = row["payload_digest"] and f"sha1:{row['payload_digest']}"
    if row["record_type"] == "revisit":
        lines["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines["Content-Length"] = len(http) + len(payload)
    # A value stays on its line.
    head = "".join(f"{h}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}\r\n" for h, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = 12
    size = 10 + 2 + extra + len(body) + 8
    field = SKIP + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", extra) + field + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Stream:
    """Bytes of one record at a time, decoded only as far as they are asked for."""

    def __init__(self, file: BinaryIO, packed: bool) -> None:
        self.file, self.packed = file, packed
        self.data = b""
        self.inflate: Any = None
        self.end = 0

    def begin(self) -> bool:
        """Goes to the next record; false at the end of the file."""
        if not self.packed:
            while self.fill(2) and self.data[:2] == b"\r\n":
                self.data = self.data[2:]
            return self.fill(1)
        start = self.file.tell()
        head = self.file.read(12)
        if len(head) < 12:
            return False
        self.end = 0
        if head[3] & 4:
            extra = self.file.read(struct.unpack("<H", head[10:])[0])
            if extra[:2] == SKIP:
                self.end = start + struct.unpack("<I", extra[4:8])[0]
        self.file.seek(start)
        self.data, self.inflate = b"", zlib.decompressobj(31)
        return True

    def fill(self, size: int) -> bool:
        """Has so many bytes decoded, if there are."""
        while len(self.data) < size:
            if not self.packed:
                more = self.file.read(max(1 << 16, size - len(self.data)))
                if not more:
                    return False
                self.data += more
                continue
            if self.inflate.eof:
                return False
            fed = self.inflate.unconsumed_tail or self.file.read(1 << 16)
            if not fed:
                return False
            self.data += self.inflate.decompress(fed, max(4096, size - len(self.data)))
        return True

    def take(self, size: int) -> bytes:
        self.fill(size)
        out, self.data = self.data[:size], self.data[size:]
        return out

    def until(self, mark: bytes) -> bytes:
        while mark not in self.data:
            if not self.fill(len(self.data) + 1):
                break
        at = self.data.find(mark)
        return self.take(at + len(mark) if at >= 0 else len(self.data))

    def skip(self, size: int) -> None:
        """Passes the rest of the record, of that many bytes, without decoding it where its length is known."""
        if not self.packed:
            kept = min(size, len(self.data))
            self.data = self.data[kept:]
            self.file.seek(size - kept, 1)
        elif self.end:
            self.file.seek(self.end)
        else:
            while not self.inflate.eof:
                self.data = b""
                if not self.fill(1):
                    break
            self.file.seek(-len(self.inflate.unused_data), 1)


def parsed(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def wanted(values: dict[str, Any], filters: list[Filter]) -> bool:
    for f in filters:
        value = values.get(f.attribute[0])
        if isinstance(f, EqualTo):
            ok = value is not None and value == f.value
        elif isinstance(f, In):
            ok = value is not None and value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        else:
            ok = value is not None
        if not ok:
            return False
    return True


def records(file: BinaryIO, packed: bool, filters: list[Filter], payloads: bool) -> Iterator[tuple[Any, ...]]:
    """Rows of the read schema for the records whose headers pass; payloads of others are not decoded."""
    stream = Stream(file, packed)
    while stream.begin():
        headers = parsed(stream.until(b"\r\n\r\n"))
        size = int(headers.get("content-length", 0))
        values = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        length, payload = None, None
        keep = wanted(values, filters)
        left = size
        if keep and "application/http" in (values["content_type"] or ""):
            http = stream.until(b"\r\n\r\n")
            left -= len(http)
            told = parsed(http).get("content-length")
            length = int(told) if told else left
            if payloads and values["record_type"] != "revisit":
                payload = stream.take(left)
                left = 0
        elif keep:
            length = size
            if payloads:
                payload = stream.take(size)
                left = 0
        stream.skip(left)
        if keep:
            yield (*values.values(), headers, length, payload)


# ---- the data source -----------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcSource(DataSource):
    """Options: path, a folder every executor reaches; payload, false to leave all payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool) -> None:
        self.path, self.payloads = path, payloads
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | IsNotNull) and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Whole files, small ones together. A written archive has a list of the files that were committed."""
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = [(name, size) for name, size in json.loads(f.read())]
        else:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted((x.path[len(root) :].lstrip("/"), x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.path))
        out: list[Files] = []
        room = 0
        for name, size in files:
            if size > room:
                out.append(Files([]))
                room = FILE_BYTES
            out[-1].names.append(name)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[Any, ...]]:
        system, root = located(self.path)
        for name in partition.names:
            with system.open_input_file(f"{root}/{name}") as f:
                yield from records(f, name.endswith(".gz"), self.filters, self.payloads)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own attempt; only those of committed tasks are listed."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                data = member(record({c: batch.column(c)[k].as_py() for c in WRITE_COLUMNS}))
                if out is None or size + len(data) > FILE_BYTES:
                    if out is not None:
                        out.close()
                        files[-1] = (files[-1][0], size)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    files.append((name, 0))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1] = (files[-1][0], size)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())


def use(spark: SparkSession) -> None:
    """Registers the source, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    use(spark)
    return spark.read.format(FORMAT).option("payload", str(payloads).lower()).load(path)


def write(rows: DataFrame, path: str) -> None:
    """Rows with the written columns, one record each; columns beside them are left out."""
    use(rows.sparkSession)
    tx.short_batches(rows.sparkSession)
    rows.select(*WRITE_COLUMNS).write.format(FORMAT).mode("append").save(path)


# ---- pages ---------------------------------------------------------------------------------------


def base32(hexed: Column) -> Column:
    """Base32 of 20 bytes given in hexadecimal: five digits are four letters."""
    letters = []
    for k in range(8):
        n = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def page_records(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """A record row for each page. Of pages with equal payloads of at least least_bytes bytes, that with the largest id
    is the response and the others revisit it; rows that repeat that id are responses as well, as are rows without id.

    A null html is an empty payload, a null url leaves its header out, an empty table gives no rows and other columns
    are left out, whatever their names. Only digests are grouped. A digest that a large part of all pages share is one
    row of the grouped side, and adaptive execution splits the pages that meet it.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    own = own.select("id", "target_uri", "payload", F.octet_length("payload").cast("long").alias("payload_length"), base32(F.sha1("payload")).alias("payload_digest"))
    same = own.filter(F.col("payload_length") >= least_bytes).groupBy("payload_digest", "payload_length").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    # Staged, so its size is known: few repeated digests are broadcast and no payload moves; for many, both sides of
    # the join are plain exchanges, and a digest of very many pages can be split.
    rows = own.join(stage_table(same.filter("n > 1")), ["payload_digest", "payload_length"], "left")
    again = F.coalesce(F.col("id") < F.col("last"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("id")).alias("record_id"), "target_uri",
        F.lit(DATE).alias("date"), F.when(again, name(F.col("last"))).alias("refers_to"), "payload_digest", "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_number(uri: str) -> Column:
    return F.regexp_extract(uri, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of an archive: of responses, length and digest are those of the payload that was read; revisits have
    no payload, so theirs come from headers, and the payloads of the responses between them are not decoded."""
    full = read(spark, path).filter("record_type = 'response'")
    full = full.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": base32(F.sha1("payload"))})
    short = read(spark, path, payloads=False).filter("record_type = 'revisit'")
    short = short.withColumn("payload_digest", F.regexp_replace("payload_digest", "^sha1:", ""))
    return full.unionByName(short).select(
        page_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"),
    )


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes all pages to an archive, by default a fresh one in the shared folder, and returns its path."""
    path = path or scratch_path(pages.sparkSession, "archive")
    write(page_records(pages), path)
    return path
