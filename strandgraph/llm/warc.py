"""A WARC data source for Spark: reads and writes web archives, one gzip member per record.

Reading plans one partition per file, or several where a file is large, takes
predicates on record headers, parses the headers of a record first and skips the
payloads of records that fail them, or all payloads where the schema asks for
none. Members written here carry their own length in the gzip header ("sl", the
skip length of the WARC standard), so a skipped record is not even decompressed
to its end. Plain files and members without that field are read as well.

Paths are opened with pyarrow.fs: local folders, and what else it knows by URI.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from strandgraph.llm.common import counted_join
from strandgraph.session import materialize

#: Columns of records; ``record_type``, ``record_id``, ``target_uri``, ``refers_to`` and ``payload_digest`` come from WARC headers,
#: ``payload_length`` from the length header inside the block, ``payload`` from the block.
SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
#: Header of each column, in lower case.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
#: Bytes of a file that one partition reads; a member belongs to the partition in which it begins.
SPLIT = 64 << 20
#: Bytes read, or decompressed, at a time while looking for the end of the headers.
STEP = 1 << 14
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


# --- records -----------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(row: dict) -> bytes:
    """The bytes of one record. Null columns make no header; a revisit has the block's headers but no payload."""
    payload = bytes(row["payload"] or b"")
    kind = row["record_type"]
    inner = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = inner + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1"] + [f"{header}: {_clean(row[name])}" for name, header in HEADERS.items() if row.get(name) is not None]
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that holds its own length and that of its contents in the extra field "sl"."""
    packed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    head = MEMBER + b"\x04" + struct.pack("<IBB", 0, 0, 255)  # flags: extra field; no time; unknown system
    extra = struct.pack("<2sHII", b"sl", 8, 0, len(data) & 0xFFFFFFFF)
    size = len(head) + 2 + len(extra) + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def skip_length(head: bytes) -> int | None:
    """The length of the member that begins with ``head``, if it says so."""
    if len(head) < 12 or not head[3] & 4:
        return None
    (size,) = struct.unpack_from("<H", head, 10)
    at, end = 12, min(12 + size, len(head))
    while at + 4 <= end:
        name, width = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and width == 8 and at + 12 <= end:
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + width
    return None


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines without a colon are passed over."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}


# --- predicates --------------------------------------------------------------


def pushable(item: Filter) -> bool:
    return isinstance(item, EqualTo | In) and len(item.attribute) == 1 and item.attribute[0] in HEADERS


@dataclass
class Wanted:
    """Values that headers must have; no column, no condition."""

    values: dict[str, list[set]] = field(default_factory=dict)

    def add(self, item: Filter) -> None:
        allowed = {item.value} if isinstance(item, EqualTo) else set(item.value)
        self.values.setdefault(item.attribute[0], []).append(allowed - {None})

    def has(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[name]) in allowed for name, sets in self.values.items() for allowed in sets)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; "file:/x" is read like "file:///x"."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


# --- reading -----------------------------------------------------------------


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int


class _Stream:
    """Bytes of a record one after the other, from a plain file or a gzip member, as many as are asked for."""

    def __init__(self, file, packed: bool):
        self.file, self.buffer = file, b""
        self.unpack = zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        if self.unpack is None:
            got = self.file.read(STEP)
        else:
            if self.unpack.eof:
                return False
            tail = self.unpack.unconsumed_tail or self.file.read(STEP)
            if not tail:
                return False
            got = self.unpack.decompress(tail, STEP)
            self.buffer += got
            return True
        self.buffer += got
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to ``mark``, which is dropped; None if it doesn't come."""
        looked = 0
        while (at := self.buffer.find(mark, looked)) < 0:
            looked = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < size and self._more():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        whole = b"".join(parts)
        self.buffer = whole[size:]
        return whole[:size]

    def end(self) -> int:
        """For a member: where the next one begins. Decompresses what is left without keeping it."""
        while not self.unpack.eof:
            self.buffer = b""
            if not self._more():
                break
        return self.file.tell() - len(self.unpack.unused_data)


def _first_member(file, start: int, stop: int) -> int | None:
    """Where the first record at or after ``start`` begins: a member whose contents begin like a record."""
    at, size = start, file.size()
    while at < stop:
        file.seek(at)
        chunk = file.read(STEP + len(MEMBER) - 1)
        found = chunk.find(MEMBER)
        while found >= 0:
            if at + found >= stop:
                return None
            file.seek(at + found)
            try:
                if zlib.decompressobj(31).decompress(file.read(STEP), 8).startswith(b"WARC/1."):
                    return at + found
            except zlib.error:
                pass
            found = chunk.find(MEMBER, found + 1)
        if at + len(chunk) >= size:
            return None
        at += STEP
    return None


def records(file, start: int, stop: int, wanted: Wanted, payload: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, payload length, payload) of the wanted records that begin from start up to stop.

    The payload is None where ``payload`` is false. A record without inner headers
    has its whole block as payload.
    """
    file.seek(0)
    packed = file.read(2) == MEMBER[:2]
    at = start
    if packed and start:
        at = _first_member(file, start, stop)
    while at is not None and at < stop:
        file.seek(at)
        skip = None
        if packed:
            skip = skip_length(file.read(64))
            file.seek(at)
        stream = _Stream(file, packed)
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        headers = parse_headers(head)
        size = int(headers.get("content-length") or 0)
        if wanted.has(headers):
            web = headers.get("content-type", "").startswith("application/http")
            inner = stream.until(b"\r\n\r\n") if web else None
            left = size - len(inner) - 4 if inner is not None else size
            length = parse_headers(inner).get("content-length") if inner is not None else None
            body = stream.take(left) if payload else None
            yield headers, int(length) if length is not None else left, body
        if not packed:
            at += len(head) + 4 + size + 4
            if at >= file.size():
                return
        else:
            at = at + skip if skip else stream.end()
            if at >= file.size():
                return


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.names = schema.names
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on header columns are exact here; all other filters stay with Spark."""
        for item in filters:
            if pushable(item):
                self.wanted.add(item)
            else:
                yield item

    def partitions(self) -> list[Split]:
        system, root = locate(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for file in sorted(found, key=lambda f: f.path):
            if file.type != fs.FileType.File or file.base_name.startswith(("_", ".")) or not file.size:
                continue
            step = self.split if file.path.endswith(".gz") else file.size  # plain files have no mark to begin at
            out += [Split(file.path, at, min(at + step, file.size)) for at in range(0, file.size, step)]
        return out

    def read(self, partition: Split) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        system, _ = locate(self.path)
        with system.open_input_file(partition.path) as file:
            for headers, length, body in records(file, partition.start, partition.stop, self.wanted, "payload" in self.names):
                values = {name: headers.get(header) for name, header in HEADERS.items()} | {"payload_length": length, "payload": body}
                yield tuple(values[name] for name in self.names)


# --- writing -----------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int


class WarcWriter(DataSourceWriter):
    """Every task attempt writes a file of its own under ``_attempts``; the commit moves those of successful tasks into place."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names

    def write(self, rows: Iterator) -> Written:
        system, root = locate(self.path)
        system.create_dir(f"{root}/_attempts", recursive=True)
        name, count = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(f"{root}/_attempts/{name}", compression=None, buffer_size=1 << 20) as file:
            for row in rows:
                file.write(member(record(row.asDict())))
                count += 1
        if not count:
            system.delete_file(f"{root}/_attempts/{name}")
        return Written(name if count else None, count)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = locate(self.path)
        for message in messages:
            if message is not None and message.name:
                system.move(f"{root}/_attempts/{message.name}", f"{root}/{message.name}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*locate(self.path))

    @staticmethod
    def _clear(system: fs.FileSystem, root: str) -> None:
        system.create_dir(root, recursive=True)
        if system.get_file_info(f"{root}/_attempts").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_attempts")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")


# --- pages -------------------------------------------------------------------

#: Payloads from this size on are written once and then referred to.
LEAST_REVISIT = 100


def as_records(pages: DataFrame, key: str, url: str, text: str, least: int = LEAST_REVISIT) -> DataFrame:
    """One record per page: a response, or a revisit if a page of a smaller key has the same payload of at least ``least`` bytes.

    Equal payloads are found by their SHA-256; per payload one smallest key is
    aggregated, before the shuffle, and only payloads that occur twice are joined
    back, so pages stay where they are while those are few. Null texts are empty.
    Null keys never are the smallest; if all keys of a payload are null, all its
    pages are responses, and so are all rows that repeat the smallest key.
    """
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = pages.select(F.col(key), F.col(url).alias("target_uri"), whole.alias("payload"))
    digest, size = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    same = rows.select(key, digest.alias("digest"), size.alias("size")).where(F.col("size") >= least).groupBy("digest")
    firsts = materialize(same.agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    rows = counted_join(rows.withColumn("digest", digest).withColumn("payload_length", size), firsts, ["digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col(key).eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(key).alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),  # the table has no dates
        F.when(revisit, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def key_of(name: str):
    """The page key in a record id; null stays null."""
    return F.regexp_extract(name, "<urn:page:(.*)>", 1).try_cast("long")
