"""WARC archives: a Python data source that writes and reads them.

Records are laid out by DataFrame functions. The writer makes each a gzip member of its own,
whose header names the member's length (the "sl" field of compressed WARC), cuts archives at a
number of bytes, and moves a task's archives to their place only when all tasks have ended, so
that attempts of lost executors leave nothing behind. The reader plans partitions of whole archives,
takes predicates on the record type and other header columns, inflates a record's header first
and steps over the rest of members that nobody asked for, which are then neither read nor inflated.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .components import with_least
from .shared import checkpointed

CRLF = "\r\n"
#: Bytes of archives that a task reads, about, and rows of a batch.
PARTITION_BYTES, BATCH_ROWS, BATCH_BYTES = 32 << 20, 1000, 8 << 20
#: Bytes at which the writer begins another archive, and bytes read at a time.
ARCHIVE_BYTES, READ_BYTES = 128 << 20, 1 << 16
#: What a gzip member with a length begins with: deflate with an extra field "sl" of eight bytes.
_MAGIC, _SL = b"\x1f\x8b\x08\x04", b"\x0c\x00sl\x08\x00"
#: Header fields that are columns of their own.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", headers map<string,string>, payload binary"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """A hexadecimal digest of 160 bits in upper-case base32."""
    fours = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; line ends in the value become spaces. Null has no line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def revisits(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``rows`` (id, digest, size) with refers_to: the largest id of an equal payload, null for that row itself and for smaller payloads.

    A payload that very many rows share meets them by broadcast, as ``components.with_least`` says.
    """
    keyed = checkpointed(rows.withColumn("key", F.concat_ws("-", "digest", "size")))
    large = keyed.filter(F.col("size") >= least_bytes)
    joined, _ = with_least(large, "key", F.col("id"), "first", large.count(), F.max)
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).alias("refers_to")
    small = keyed.filter(F.col("size") < least_bytes).select(*rows.columns, F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"))
    return joined.select(*rows.columns, refers).unionByName(small)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Adds a response or revisit record for each row of ``pages`` to the archives below ``path``, ended at ``archive_bytes`` or soon after.

    Payload: the text in UTF-8, null as empty. Of equal payloads of ``least_bytes`` or more the row
    with the largest id is the response; the others are revisits, which hold no payload but name
    its digest, length and the response. Rows that repeat an id are each written, all responses
    if theirs is the largest. Null ids and URLs have no such header; a row without an id is a
    revisit wherever another has one. Extra columns are left out. A text must fit in a Spark value;
    ``compression`` is gzip, a member for each record, or none.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    keys = pages.select(F.col(id_col).alias("id"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("bigint").alias("size")).distinct()
    refers = revisits(keys, least_bytes).filter("refers_to is not null").select(F.col("id").alias("_id"), "digest", F.col("refers_to").alias("_refers"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("text"))
    rows = rows.withColumns({"digest": F.sha1(F.col("text").cast("binary")), "size": F.octet_length("text")})
    rows = rows.join(refers, rows["id"].eqNullSafe(F.col("_id")) & (rows["digest"] == refers["digest"]), "left").drop(refers["digest"])
    again = F.col("_refers").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("text")))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(F.col("id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        _line("WARC-Refers-To", name(F.col("_refers"))),
        _line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("X-Payload-Length", F.col("size").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    record = F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)
    record = F.concat(record, F.lit(CRLF + CRLF)).cast("binary")
    pages.sparkSession.dataSource.register(WarcSource)
    rows.select(record.alias("record")).write.format("warc").mode("append").option("path", path).option("compression", compression).option("archiveBytes", archive_bytes).save()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; Spark's name for S3 is one of Arrow's."""
    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def _member(record: bytes) -> bytes:
    """A gzip member that names its length and the record's."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = _MAGIC + bytes(5) + b"\xff" + _SL
    return head + struct.pack("<II", len(head) + 16 + len(body), len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record))


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes laid-out records to archives in a folder of the job's own, and moves those of the tasks that count."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("archivebytes", ARCHIVE_BYTES))
        self.gzip = options.get("compression", "gzip").lower() == "gzip"
        self.folder = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        task, names, out, size = TaskContext.get(), [], None, 0
        try:
            for record in (r.as_py() for batch in iterator for r in batch.column(0)):
                if out is None:
                    names.append(f"part-{task.partitionId():05d}-{len(names):05d}-{task.taskAttemptId()}.warc" + ".gz" * self.gzip)
                    out, size = store.open_output_stream(f"{root}/{self.folder}/{names[-1]}", compression=None), 0
                data = _member(record) if self.gzip else record
                out.write(data)
                size += len(data)
                if size >= self.size:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        job = self.folder[-8:]
        with ThreadPool(16) as pool:  # names only: no data passes here
            pool.map(lambda n: store.move(f"{root}/{self.folder}/{n}", f"{root}/{job}-{n}"), [n for m in messages if m for n in m.names])
        store.delete_dir(f"{root}/{self.folder}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        store.delete_dir(f"{root}/{self.folder}")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _header(stream: io.BufferedReader) -> dict[str, str] | None:
    """The fields of the next record's header, or None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _payload(block: bytes, content_type: str) -> bytes:
    """What follows the HTTP header, for HTTP content; else the block."""
    return block.partition(b"\r\n\r\n")[2] if content_type.startswith("application/http") else block


def _skip(stream: io.BufferedReader, n: int) -> None:
    while n > 0:
        n -= len(stream.read(min(n, 1 << 20))) or n


Record = tuple[dict[str, str], Callable[[], bytes]]


def _plain(stream: io.BufferedReader) -> Iterator[Record]:
    """The records of a stream in order; what of a block is not asked for is passed over."""
    while (h := _header(stream)) is not None:
        length, taken = int(h.get("content-length", 0)), []

        def take() -> bytes:
            taken.append(length)
            return stream.read(length)

        yield h, take
        if not taken:
            _skip(stream, length)


def _records(stream: io.BufferedReader) -> Iterator[Record]:
    """Each record's header, and what gives its block.

    Of members that name their length only as much is inflated as the header needs, and the file is
    read on at the next one unless the block is asked for. Other gzip streams, from the first such
    member on, are inflated throughout.
    """
    while True:
        at = stream.tell()
        head = stream.read(20)
        if not head:
            return
        if not (head[:4] == _MAGIC and head[10:16] == _SL):
            stream.seek(at)
            yield from _plain(io.BufferedReader(gzip.GzipFile(fileobj=stream), READ_BYTES) if head[:2] == _MAGIC[:2] else stream)
            return
        size = struct.unpack("<I", head[16:])[0]
        left, inflate = size - len(head), zlib.decompressobj(31)
        record = inflate.decompress(head)
        while b"\r\n\r\n" not in record and left:
            part = stream.read(min(left, 2048))
            if not part:
                raise EOFError("an archive ends within a record")
            left -= len(part)
            record += inflate.decompress(part)
        lines = io.BytesIO(record)
        h = _header(lines)
        if h is None:
            raise ValueError("a member holds no WARC record")

        def take() -> bytes:
            block = lines.read() + inflate.decompress(stream.read(left))
            if not inflate.eof:
                raise EOFError("an archive ends within a record")
            return block[: int(h.get("content-length", 0))]

        yield h, take
        stream.seek(at + size)


_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes predicates on header columns; yields those left to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole archives, put together up to about ``partitionBytes``."""
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        hidden = lambda p: any(n.startswith(("_", ".")) for n in p[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and not hidden(f.path))
        out, total = [], self.size
        for path, size in files:
            if total + size > self.size and (total or not out):
                out.append([])
                total = 0
            out[-1].append(path)
            total += size
        return [_Files(p) for p in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for h, take in _records(io.BufferedReader(raw, READ_BYTES)):
                    row = [h.get(name.lower()) for name in FIELDS.values()]
                    columns = dict(zip(FIELDS, row))
                    if not all(_TESTS[type(f)](columns[f.attribute[0]], f) for f in self.filters):
                        continue
                    payload = None
                    if self.payloads and columns["record_type"] != "revisit":
                        payload = _payload(take(), h.get("content-type", ""))
                    rows.append((*row, list(h.items()), payload))
                    held += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(FIELDS) + [pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*FIELDS, "headers", "payload"])


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options path, payload (false: none is read) and partitionBytes.

    Records that are no revisits have their payload, HTTP content without its HTTP header.
    Archives may be gzipped, a member for each record or as a whole. ``write`` takes one binary column
    of laid-out records, appends, and has the options path, compression and archiveBytes. The path may
    be any URI that Arrow's file systems open, for both.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to a folder, not overwritten")
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``; header predicates are pushed down.

    This turns on the session's push-down to Python data sources, which Spark has off.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
