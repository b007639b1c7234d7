"""WARC archives as a PySpark Python data source.

Reading plans one partition for each archive file. Filters on the record type and on header fields
are pushed into the reader, which parses a record's header block first and, for a record that the
filters reject, seeks over its payload. In a compressed archive each record is a gzip member whose own
header says how long it is (an extra field, which other readers pass over), so of a rejected record
only the first few kilobytes are inflated; archives of others, without that field, are inflated whole.
Writing makes one archive for each task, under a temporary name until the task is committed.

Paths go through pyarrow's file systems, so an archive can lie in any store that they know.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from millrace.llm.shared import shared_path, written

#: Columns that come from the header block, and the header that each is read from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
#: An extension field: the length of the payload that a revisit record stands for.
LENGTH_FIELD = "WARC-X-Payload-Length"
ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record. Line ends within a header value become spaces."""
    lines = ["WARC/1.1"]
    lines += [f"{k}: {' '.join(v.splitlines())}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: The subfield of a gzip header with the member's length and that of what it holds.
LENGTHS = b"sl"
#: Bytes read at once while a record's header is looked for.
PEEK = 4096


def member_bytes(record: bytes, level: int) -> bytes:
    """A record as a gzip member that says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 20)
    extra = LENGTHS + struct.pack("<HQQ", 16, len(head) + 20 + len(body) + 8, len(record))
    return head + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def member_length(stream) -> int | None:
    """The length that the gzip member at the stream's place says it has, the stream standing behind its
    header; None at the end, 0 where it does not say."""
    head = stream.read(12)
    if len(head) < 12:
        return None
    if head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = stream.read(struct.unpack("<H", head[10:])[0])
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == LENGTHS and n == 16:
            return struct.unpack("<Q", extra[4:12])[0]
        extra = extra[4 + n :]
    return 0


class Member(io.RawIOBase):
    """What a gzip member holds, inflated as far as it is read."""

    def __init__(self, stream):
        self.stream, self.inflate = stream, zlib.decompressobj(-zlib.MAX_WBITS)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.inflate.eof:
            data = self.inflate.decompress(self.inflate.unconsumed_tail or self.stream.read(PEEK), len(into))
            if data:
                into[: len(data)] = data
                return len(data)
        return 0


def read_header(stream) -> dict[str, str] | None:
    """The fields of the next record, or none at the end. Blank lines before a record are skipped."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded line
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


@dataclass
class ArchiveFile(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters):
        """Equality and membership of header columns are checked before a payload is touched."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS:
                self.wanted.append((HEADERS[name].lower(), frozenset([f.value])))
            elif isinstance(f, In) and name in HEADERS:
                self.wanted.append((HEADERS[name].lower(), frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        found = [
            ArchiveFile(x.path, x.size)
            for x in store.get_file_info(fs.FileSelector(root, recursive=True))
            if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))
        ]
        return sorted(found, key=lambda x: (-x.size, x.path)) or [ArchiveFile("", 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            if partition.path.endswith(".gz"):
                says = member_length(stream)
                stream.seek(0)
                yield from self._batches(self._members(stream) if says else self._records(gzip.GzipFile(fileobj=stream)))
            else:
                yield from self._batches(self._records(stream))

    def _rejected(self, fields: dict[str, str]) -> bool:
        return any(fields.get(name) not in values for name, values in self.wanted)

    def _records(self, stream) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """The wanted records of a stream: fields, and the payload if it is asked for."""
        while (fields := read_header(stream)) is not None:
            length = int(fields.get("content-length", 0))
            if self._rejected(fields) or not self.payload:
                stream.seek(length, 1)
                if not self._rejected(fields):
                    yield fields, None
            else:
                yield fields, stream.read(length)

    def _members(self, stream) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """The same of an archive whose members say how long they are."""
        start = 0
        while (length := member_length(stream)) is not None:
            record = io.BufferedReader(Member(stream), PEEK)
            fields = read_header(record)
            if fields is not None and not self._rejected(fields):
                yield fields, record.read(int(fields.get("content-length", 0))) if self.payload else None
            if not length:
                raise ValueError("a member of the archive does not say how long it is")
            start += length
            stream.seek(start)

    def _batches(self, records: Iterator[tuple[dict[str, str], bytes | None]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for fields, block in records:
            full = int(fields.get(LENGTH_FIELD.lower(), fields.get("content-length", 0)))
            rows.append((*(fields.get(h.lower()) for h in HEADERS.values()), full, block))
            held += 500 + (len(block) if block else 0)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, t) for column, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW
    )


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Writes the columns of SCHEMA; ``payload_bytes`` is taken from the payload where null."""

    def __init__(self, options):
        self.path = options["path"]
        self.compress = int(options.get("compression_level", 1))

    def write(self, iterator):
        store, root = fs.FileSystem.from_uri(self.path)
        name = uuid.uuid4().hex
        end = ".warc.gz" if self.compress else ".warc"
        store.create_dir(root, recursive=True)
        message = Written(posixpath.join(root, f"_{name}.tmp"), posixpath.join(root, f"records-{name}{end}"))
        with store.open_output_stream(message.temporary, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    block = row["payload"] or b""
                    fields = {h: row[c] for c, h in HEADERS.items()}
                    if row["payload_bytes"] is not None:
                        fields[LENGTH_FIELD] = str(row["payload_bytes"])
                    record = record_bytes(fields, block)
                    # each record is a gzip member of its own, as readers of WARC expect
                    out.write(member_bytes(record, self.compress) if self.compress else record)
        return message

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)

    def abort(self, messages):
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option payload=false leaves payloads null.

    ``df.write.format("warc").mode("append").save(path)`` with the columns of SCHEMA; option
    compression_level, 0 for plain files, in which unwanted payloads are skipped by seeking."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Payloads that more than this share of the rows have are looked up from a broadcast table, which
#: has 1 / HOT_SHARE rows at most.
HOT_SHARE = 0.001


def with_revisits(df: DataFrame, payload: Column, record_id: Column, min_bytes: int = 0) -> DataFrame:
    """``df`` (as the struct ``row``) with payload, id, sha (hex) and ``first`` added: of records
    with equal payloads of at least ``min_bytes`` bytes, the largest id.

    Payloads that many rows share go to many tasks: their first ids come from a broadcast of at
    most 1 / HOT_SHARE rows, and only the other rows meet theirs in a shuffle.
    """
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), payload.alias("payload"), record_id.alias("id")
    ).withColumn("sha", F.sha1("payload"))
    shared = written(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("sha")
        .agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1"),
        "warc-payloads",
    )
    least = max(2, int(HOT_SHARE * (shared.agg(F.sum("n")).first()[0] or 0)))
    hot = shared.filter(F.col("n") >= least).select("sha", F.col("first").alias("hot")) if least > 2 else None
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "sha", "left")
    else:
        rows = rows.withColumn("hot", F.lit(None).cast(shared.schema["first"].dataType))
    # a row that has its first id already takes no part in the shuffle's matching
    meet = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string")))
    cold = shared.filter(F.col("n") < least) if least > 2 else shared
    return (
        rows.withColumn("meet", meet)
        .join(cold.select(F.col("sha").alias("meet"), "first"), "meet", "left")
        .withColumn("first", F.coalesce("hot", "first"))
        .drop("meet", "hot")
    )


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, compression_level: int = 1) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html; the payload is the html in
    UTF-8, empty for null).

    Of records with equal payloads, that with the largest page_id is a response and the others
    revisit it and carry no payload; rows that are equal in page_id and payload are of one type. A
    null page_id is smaller than all others and written as ``<urn:page:>``.
    """
    register(pages.sparkSession)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = with_revisits(pages.select("page_id", "url", "html"), html, F.col("page_id"), min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("row.url").alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("compression_level", compression_level).save(path)


def base32(sha_hex: Column) -> Column:
    """The base32 form of 40 hexadecimal digits: five of them give four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(sha_hex, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(letters), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records at
    ``path``. Length and digest of a response are those of the payload that was read back."""
    register(spark)
    # a read of its own for each filter: scans of one relation would share what was pushed down
    records = lambda kind: spark.read.format("warc").load(path).filter(F.col("record_type") == kind)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    whole = records("response").select(
        number(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    again = records("revisit").select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
    return whole.unionByName(again)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    path = shared_path(pages.sparkSession, "warc")
    write_pages(pages, path, min_bytes)
    return read_pages(pages.sparkSession, path)
