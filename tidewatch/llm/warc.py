"""WARC archives as a Spark data source (operator 5)."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidewatch.functions.scratch import save, scratch_path

#: Bytes after which a task starts a new file, and of files that a read task takes.
FILE_BYTES, READ_BYTES = 64 << 20, 64 << 20
#: Payloads shorter than this are never revisits.
LEAST_PAYLOAD = 100
ROWS = 512
BATCH_BYTES = 8 << 20

SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"
#: Columns that stand in the header, and the header fields they come from.
FIELDS = {
    "page_id": "X-Page-ID",
    "url": "WARC-Target-URI",
    "record_type": "WARC-Type",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "X-Refers-To-Page",
}
_NUMBERS = {"page_id", "payload_bytes", "refers_to"}
#: Fixed values of the WARC standard.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` tells its whole and its unpacked length, so that readers can skip it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(row: dict) -> bytes:
    """One record, its header and its block in a gzip member each."""
    payload = (row["payload"] or "").encode()
    revisit = row["record_type"] == "revisit"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if row["url"] is None else quote(row["url"], safe="".join(map(chr, range(33, 127))))),
        ("WARC-Payload-Digest", "sha256:" + row["payload_digest"]),
        ("X-Page-ID", row["page_id"]),
        ("X-Payload-Length", row["payload_bytes"]),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"])), ("X-Refers-To-Page", row["refers_to"])]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    head = "".join([f"{name}: {value}\r\n" for name, value in fields if value is not None])
    return member(f"{VERSION}\r\n{head}\r\n".encode()) + member(payload + b"\r\n\r\n")


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = [line.partition(":") for line in lines[1:] if line]
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Source:
    """Reads records of one file: packed with skip lengths, packed without, or not packed."""

    def __init__(self, file):
        self.file, self.rest = file, b""
        self.packed = file.read(2) == b"\x1f\x8b"
        file.seek(0)

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Headers, and blocks of those that ``wanted`` says; other blocks are skipped and not unpacked."""
        while True:
            if not self.packed:
                head = self._lines()
                if not head:
                    return
                fields = parse_header(head)
                size = int(fields["content-length"])
                keep = wanted(fields)
                block = self._take(size + 4) if keep == 2 else self._pass(size + 4)
            else:
                data = self._member()
                if data is None:
                    return
                head, _, block = data.partition(b"\r\n\r\n")
                fields = parse_header(head)
                size, keep = int(fields["content-length"]), wanted(fields)
                if not block:  # the block is a member of its own
                    block = self._member(skip=keep < 2)
            if keep:
                yield fields, None if block is None or keep < 2 else block[:size]

    def _take(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.file.read(max(n - len(self.rest), 1 << 16))):
            self.rest += more
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def _pass(self, n: int) -> None:
        here = min(n, len(self.rest))
        self.rest = self.rest[here:]
        if n > here:
            self.file.seek(self.file.tell() + n - here)

    def _lines(self) -> bytes:
        while b"\r\n\r\n" not in self.rest and (more := self.file.read(1 << 14)):
            self.rest += more
        head, _, self.rest = self.rest.partition(b"\r\n\r\n")
        return head

    def _member(self, skip: bool = False) -> bytes | None:
        start = self._take(24)
        if len(start) < 18:
            return None
        if start[3] & 4 and start[12:14] == b"sl":
            whole, size = struct.unpack("<II", start[16:24])
            if skip:
                return self._pass(whole - 24)
            body = self._take(whole - 24)
            data = zlib.decompress(body[:-8], -15, size)
            if zlib.crc32(data) != struct.unpack("<I", body[-8:-4])[0]:
                raise ValueError("damaged gzip member")
            return data
        unpacker, out = zlib.decompressobj(31), []
        held = start + self.rest
        self.rest = b""
        while True:
            out.append(unpacker.decompress(held))
            if unpacker.eof:
                self.rest = unpacker.unused_data
                return b"".join(out)
            held = self.file.read(1 << 16)
            if not held:
                raise ValueError("a gzip member ends early")


@dataclass
class WarcFiles(InputPartition):
    paths: tuple[str, ...]


@dataclass
class WarcWritten(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    """Plans runs of files, checks headers first, and unpacks only payloads that are asked for.

    Comparisons of header columns with constants are taken over from Spark; a record that fails one is
    skipped without its block being read.  The payload is only unpacked if the schema has it.
    """

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, list(schema.names)
        self.schema = pa.schema([(f.name, pa.int64() if f.name in _NUMBERS else pa.string()) for f in schema.fields])
        self.checks: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "=", In: "in", IsNotNull: "there", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for one in filters:
            sign, column = kinds.get(type(one)), getattr(one, "attribute", ())
            if sign is None or len(column) != 1 or column[0] not in FIELDS:
                yield one
            else:
                self.checks.append((column[0], sign, getattr(one, "value", None)))

    def partitions(self) -> Sequence[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        lists = _lists(system, root)
        if lists:
            files = sorted((f"{root}/{name}", size) for one in lists for name, size in _listed(system, one))
        else:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))
        runs: list[list[str]] = []
        size = READ_BYTES
        for path, n in files:
            if size + n > READ_BYTES:
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [WarcFiles(tuple(run)) for run in runs] or [WarcFiles(())]

    def value(self, name: str, fields: dict[str, str]):
        held = fields.get(FIELDS[name].lower())
        if held is None:
            return None
        if name == "payload_digest":
            return held.removeprefix("sha256:")
        return int(held) if name in _NUMBERS else held

    def wanted(self, fields: dict[str, str]) -> int:
        """0: not this record; 1: its header; 2: its block too."""
        for name, sign, given in self.checks:
            held = self.value(name, fields)
            if held is None:
                return 0
            good = sign == "there" or sign == "=" and held == given or sign == "in" and held in given
            good = good or sign == "<" and held < given or sign == "<=" and held <= given or sign == ">" and held > given or sign == ">=" and held >= given
            if not good:
                return 0
        return 2 if "payload" in self.names and fields.get("warc-type") != "revisit" else 1

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        size = 0
        system = fs.FileSystem.from_uri(self.path)[0]
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for fields, block in _Source(file).records(self.wanted):
                    if block is not None and hashlib.sha256(block).hexdigest() != self.value("payload_digest", fields):
                        raise ValueError(f"a payload in {path} does not have the digest in its header")
                    size += len(block or b"")
                    rows.append([(None if block is None else block.decode("utf-8", "replace")) if n == "payload" else self.value(n, fields) for n in self.names])
                    if len(rows) >= ROWS or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


def _lists(system: fs.FileSystem, root: str) -> list[str]:
    """The lists of files in a folder, one for each write that ended."""
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("_files") and f.base_name.endswith(".json"))


def _listed(system: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    with system.open_input_stream(path) as file:
        return [(name, size) for name, size in json.loads(file.read())]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; a list of those of the tasks that counted is written at the end.

    A repeated or lost task leaves files that are in no list, and readers don't see them.  Every write that
    appends has a list of its own, and readers take all lists.  One that overwrites takes away the earlier
    lists and their files once its own list is there.
    """

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        files, out, name, size = [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record(row)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return WarcWritten(tuple(files))

    def commit(self, messages: list[WarcWritten | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        earlier = _lists(system, root) if self.overwrite else []
        name = f"files-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{root}/.{name}", compression=None) as file:
            file.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        system.move(f"{root}/.{name}", f"{root}/_{name}")
        for one in earlier:
            files = _listed(system, one)
            system.delete_file(one)
            for file, _ in files:
                system.delete_file(f"{root}/{file}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; a schema without ``payload`` leaves payloads packed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record per row: of equal payloads of ``LEAST_PAYLOAD`` bytes or more the smallest id is a response, others revisit it.

    Null pages count as empty.  Rows with the smallest id of a payload are all responses; rows with a null id revisit it, or
    are responses if no row with the payload has an id.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"),
    )
    keys = save(rows.filter(F.col("payload_bytes") >= LEAST_PAYLOAD).select("page_id", "payload_digest"), "payload_keys")
    # Only payloads that occur again matter: those that do not are left out before anything is joined.
    groups = keys.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = save(groups.filter("refers_to IS NOT NULL").select("payload_digest", "refers_to"), "payload_groups")
    joined = rows.join(groups, "payload_digest", "left")
    revisit = F.col("refers_to").isNotNull() & F.coalesce(F.col("page_id") != F.col("refers_to"), F.lit(True)) & (F.col("payload_bytes") >= LEAST_PAYLOAD)
    joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_digest", "payload_bytes",
        F.when(revisit, F.col("refers_to")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes an archive of all pages and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of responses, the payload is unpacked and its length and digest are its own; revisits have them in the header.
    An empty table gives an empty archive and no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    columns = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    responses = read_warc(spark, path).filter("record_type = 'response'")
    responses = responses.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    revisits = read_warc(spark, path, ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("payload string"))).filter("record_type = 'revisit'")
    return responses.select(*columns).unionByName(revisits.select(*columns))
