"""WARC archives as a Spark data source, and pages written with revisit records.

Reading plans one partition per group of files, hands record-type and header
conditions to the reader, parses a record's header first, and skips the payload
of records that are not wanted: it is read past in the stream but neither kept
nor decoded. Writing gives one archive per task; a task that is repeated leaves
no second archive, because only files named in the final commit are moved in.

Damaged archives are read as far as they go. Bytes that are no record are passed over
up to the next line that begins one; a gzip member that cannot be inflated ends there,
and reading goes on with the next member. A record whose head can be read gives a row:
with NULL for the payload if its end is missing or its length is no number. Lines may
end without a carriage return; an HTTP body that does not begin with a status line is
payload as a whole, and a head that no blank line ends has an empty payload. A record
whose own head is cut gives no row.

Defined cases: a NULL or empty payload is empty; payloads below 1000 bytes are
always responses; of rows that repeat the largest page_id of a group all are
responses; NULL ids count as the smallest; a header value keeps no line breaks; an
empty table writes no archive and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
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
    StringStartsWith,
    WriterCommitMessage,
)

from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage, new_folder

#: The profile that names a payload equal to an earlier one, and the record's version.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
#: Payloads of fewer bytes are stored again instead of being referred to.
REVISIT_BYTES = 1000
#: Bytes of archives that one partition reads, and of records in one batch.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: A header line is read in pieces of so many bytes at most.
LONGEST_LINE = 1 << 20
#: Fixed value: how a gzip member begins.
GZIP_MAGIC = b"\x1f\x8b\x08"
#: What a damaged member raises.
DAMAGED = (zlib.error, EOFError)
#: Spark's setting that lets Python sources see filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Columns that conditions can be tested on before the payload, with the header they come from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
SCHEMA = ", ".join([*[f"{name} string" for name in HEADERS], "content_length long", "payload binary"])
FIELDS = pa.schema(
    [*[(name, pa.string()) for name in HEADERS], ("content_length", pa.int64()), ("payload", pa.binary())]
)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return pyarrow.fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))


@dataclass
class Archives(InputPartition):
    files: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class Inflated(io.RawIOBase):
    """The bytes of a gzip file member by member; a damaged member raises once and is left."""

    def __init__(self, raw):
        self.raw, self.held, self.member, self.ended = raw, b"", None, False

    def readable(self) -> bool:
        return True

    def _more(self) -> bool:
        read = self.raw.read(1 << 20)
        self.held += read
        return bool(read)

    def _begin(self) -> bool:
        """Go to the next place where a member begins."""
        while (at := self.held.find(GZIP_MAGIC)) < 0:
            self.held = self.held[-len(GZIP_MAGIC) + 1 :]
            if not self._more():
                return False
        self.held, self.member = self.held[at:], zlib.decompressobj(31)
        return True

    def readinto(self, buffer) -> int:
        while self.member is not None or self._begin():
            if not self.held and not self._more():
                self.member = None
                raise EOFError("the last member is cut")
            try:
                data = self.member.decompress(self.held, len(buffer))
            except zlib.error:
                self.held, self.member = self.held[1:], None
                raise
            if self.member.eof:
                self.held, self.member = self.member.unused_data, None
            else:
                self.held = self.member.unconsumed_tail
            if data:
                buffer[: len(data)] = data
                return len(data)
        return 0


def _header_block(stream) -> dict[str, str] | None:
    """The next record's headers by lower-case name, or None at the end or if they are cut."""
    whole = True
    while (line := stream.readline(LONGEST_LINE)) and not (whole and line.startswith(b"WARC/")):
        whole = line.endswith(b"\n")
    if not line:
        return None
    headers: dict[str, str] = {}
    while line := stream.readline(LONGEST_LINE):
        line = line.rstrip(b"\r\n")
        if not line:
            return headers
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    return None


def _skip(stream, size: int) -> None:
    if stream.seekable():
        stream.seek(size, io.SEEK_CUR)
        return
    while size > 0 and (read := len(stream.read(min(size, 1 << 16)))):
        size -= read


def _length(value: bytes | str | None) -> int | None:
    """A length given in a header, if it is one."""
    text = value.decode("latin-1") if isinstance(value, bytes) else value or ""
    return int(text) if text.strip().isascii() and text.strip().isdigit() else None


def _http_head(stream, length: int) -> bytes:
    """The head of an HTTP message of ``length`` bytes, with its blank line; empty if it has none."""
    lines, size = [], 0
    while size < length and (line := stream.readline(min(length - size, LONGEST_LINE))):
        lines.append(line)
        size += len(line)
        if line in (b"\r\n", b"\n") or not lines[0].startswith(b"HTTP/"):
            break
    return b"".join(lines)


def _http_length(head: bytes) -> int | None:
    for line in head.split(b"\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return _length(value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take the conditions on header columns; the others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe) and isinstance(f.value, str):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "there", ()))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        """Files in groups of about ``PARTITION_BYTES``."""
        store, folder = _store(self.path)
        listing = store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        files = sorted(
            (f.path, f.size) for f in listing if f.base_name.endswith((".warc", ".warc.gz"))
        )
        groups: list[Archives] = []
        held, size = [], 0
        for path, bytes_ in files:
            if held and size + bytes_ > PARTITION_BYTES:
                groups.append(Archives(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += bytes_
        return [*groups, Archives(tuple(held))]  # without files, one partition that reads none

    def _wanted(self, row: dict) -> bool:
        for name, kind, values in self.tests:
            x = row[name]
            if x is None or kind == "in" and x not in values or kind == "starts" and not x.startswith(values):
                return False
        return True

    def _payload(self, stream, before: bytes, size: int) -> bytes | None:
        """``before`` and the next ``size`` bytes, None if they are cut."""
        data = stream.read(size)
        return before + data if len(data) == size else None

    def _fill(self, row: dict, headers: dict[str, str], stream) -> None:
        """Read a record's body: its length and, if it is wanted, its payload."""
        length = _length(headers.get("content-length", "0"))
        if length is None:
            return
        before = b""
        if headers.get("content-type", "").startswith("application/http"):
            before = _http_head(stream, length)
            length -= len(before)
            if before.startswith(b"HTTP/"):
                row["content_length"] = _http_length(before)
                before = b""
        if row["content_length"] is None and row["record_type"] != "revisit":
            row["content_length"] = length + len(before)
        if self.payload and row["record_type"] != "revisit":
            row["payload"] = self._payload(stream, before, length)
        else:
            _skip(stream, length)

    def records(self, stream) -> Iterator[dict]:
        """The wanted records of a buffered stream; see the module on damaged ones."""
        while True:
            try:
                headers = _header_block(stream)
                if headers is None:
                    return
                row = {name: headers.get(header) for name, header in HEADERS.items()}
                row |= {"content_length": None, "payload": None}
                if row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            except DAMAGED:
                continue
            wanted = self._wanted(row)
            try:
                if wanted:
                    self._fill(row, headers, stream)
                else:
                    _skip(stream, _length(headers.get("content-length", "0")) or 0)
            except DAMAGED:
                pass
            if wanted:
                yield row

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for file in partition.files:
            with store.open_input_file(file) as raw:
                stream = Inflated(raw) if file.endswith(".gz") else raw
                held, size = [], 0
                for row in self.records(io.BufferedReader(stream, 1 << 20)):
                    held.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, FIELDS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, FIELDS)


def _line(value) -> str:
    return " ".join(str(value).split())


def record(row: dict) -> bytes:
    """One record; a revisit has the headers of the response it repeats, without the payload."""
    payload = row["payload"] or b""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    body = head if row["record_type"] == "revisit" else head + payload
    headers = [
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if row["target_uri"] is not None:
        headers.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["record_type"] == "revisit":
        headers += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {SAME_PAYLOAD}"]
    return VERSION + b"\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        out = None
        for batch in iterator:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if out is None:
                        store.create_dir(f"{folder}/_unfinished")
                        out = store.open_output_stream(f"{folder}/_unfinished/{name}", compression=None)
                    data = record(row)
                    out.write(gzip.compress(data, 6, mtime=0) if self.gzip else data)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m and m.file:
                store.move(f"{folder}/_unfinished/{m.file}", f"{folder}/{m.file}")
        self._tidy()

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy()

    def _tidy(self) -> None:
        store, folder = _store(self.path)
        unfinished = posixpath.join(folder, "_unfinished")
        if store.get_file_info(unfinished).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(unfinished)


class WarcDataSource(DataSource):
    """``format("warc")`` with options path, payload (false: headers only), compression."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let it see filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A record per page, with equal payloads stored once.

    Payloads are grouped by digest in a table of digests alone, and only those
    that several pages share meet their pages again.
    """
    rows = take(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"),
    )
    digest = F.sha1("payload")
    shared = cut_lineage(
        rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(digest.alias("digest"))
        .agg(F.max("page_id").alias("response"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("digest", "response")
    )
    named = lambda id_: F.concat(F.lit("<urn:x-page:"), id_.cast("string"), F.lit(">"))
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(shared, digest == F.col("digest"), "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(named(F.col("page_id")), F.lit("<urn:x-page:>")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.when(revisit, named(F.col("response"))).alias("refers_to"),
        F.lit(None).cast("long").alias("content_length"),
        "payload",
    )


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    folder = new_folder(spark)
    write_archives(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    records = read_archives(spark, folder)
    page = lambda name: F.regexp_extract(name, r"<urn:x-page:(-?\d+)>", 1)
    number = lambda name: F.when(page(name) != "", page(name)).cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("content_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP8_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as size from pages
),
g as (select html, max(page_id) as response from p where size >= 1000 group by html)
select p.page_id, size as payload_bytes, sha1(p.html) as payload_digest,
  case when g.response <> p.page_id then 'revisit' else 'response' end as record_type,
  case when g.response <> p.page_id then g.response end as refers_to
from p left join g on g.html = p.html and p.size >= 1000
"""
