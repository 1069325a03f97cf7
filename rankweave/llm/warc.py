"""WARC as a PySpark Python data source, and the writing of archives with revisit records for repeated payloads.

Reading (format "warc"): the plan lists the files under the path and packs small ones together; a file is one partition at least, as records
can only be found in order. Headers are parsed first. Equality and IN filters on record_type and on the header
columns (target_uri, record_id, payload_digest, refers_to) are pushed down: the payload of a record that they refuse is skipped,
by seeking, and never decoded or inflated. Columns are those of the schema given to the reader; one without payload reads no payload.
Compressed archives (.warc.gz) have a gzip member a record; members with the skip lengths of the standard's "sl" field are skipped
by seeking too, others have to be inflated.

Writing: each task writes one archive after another of about roll_bytes under a temporary name; the commit gives the archives
their names, so a task that is run again leaves no half archive behind. Paths may be of any store that pyarrow.fs knows.

Defined results: a null payload is an empty one; invalid header lines are passed over; a record without a valid
Content-Length ends its file with an error; an empty table gives no archive; an empty folder no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from rankweave.llm.common import bounded_batches, scratch, ship

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, content_type string, content_length long, payload binary"
#: The header line of each pushed column.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length", "refers_to": "warc-refers-to", "content_type": "content-type"}
#: Fixed value: the profile of revisit records that stand for an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """The bytes of one record. A revisit carries digest and length of its payload, not the payload."""
    body = b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if uri:
        lines.append(f"WARC-Target-URI: {uri}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


def packed(data: bytes) -> bytes:
    """A record as a gzip member that says how long it is."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, len(body) + 32, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; nothing if this is no record."""
    if not lines or not lines[0].startswith(b"WARC/"):
        return {}
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def _plain(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """Headers of each record, and how to read its block if it is wanted."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        lines = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        head = _headers(lines)
        start, length = stream.tell(), int(head.get("content-length", 0))
        yield head, lambda: stream.read(length)
        stream.seek(start + length)


def _packed(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """The same for a gzip member a record: inflated up to the end of the headers, and further only if need be."""
    while True:
        start = stream.tell()
        fixed = stream.read(10)
        if not fixed:
            return
        if fixed[:3] != b"\x1f\x8b\x08":
            yield {}, bytes
            return
        member, flags = 0, fixed[3]
        if flags & 4:
            extra = stream.read(struct.unpack("<H", stream.read(2))[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n >= 4:
                    member = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for flag in (8, 16):  # a name, a comment
            if flags & flag:
                while stream.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            stream.read(2)
        inflate = zlib.decompressobj(-15)
        seen, begun = bytearray(), stream.tell()

        def more(size: int = 1 << 14, inflate=inflate, seen=seen) -> bool:
            data = inflate.unconsumed_tail or stream.read(size)
            seen.extend(inflate.decompress(data, 1 << 16))
            return bool(data) and not inflate.eof

        while b"\r\n\r\n" not in seen and more(2048):
            pass
        end = seen.find(b"\r\n\r\n")
        head = _headers(bytes(seen[: max(end, 0)]).split(b"\r\n"))
        need = end + 4 + int(head.get("content-length", 0))

        def block(seen=seen, need=need, end=end, more=more) -> bytes:
            while len(seen) < need and more():
                pass
            return bytes(seen[end + 4 : need])

        yield head, block
        if member:
            stream.seek(start + member)
        else:
            stream.seek(begun)
            inflate = zlib.decompressobj(-15)
            while not inflate.eof and (data := stream.read(1 << 16)):
                while data and not inflate.eof:
                    inflate.decompress(data, 1 << 20)
                    data = inflate.unconsumed_tail
            stream.seek(-len(inflate.unused_data) + 8, io.SEEK_CUR)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path); df.write.format("warc").save(path) of record_type, record_id, target_uri, date, refers_to, payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], [f.name for f in schema.fields], int(self.options.get("pack_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", 64 << 20)), self.options.get("compression", "none") == "gzip")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], pack_bytes: int):
        self.path, self.columns, self.pack_bytes = path, columns, pack_bytes
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and name in PUSHED:
                yield f  # the equality beside it says more; Spark looks again
            elif name in PUSHED and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted[name] = self.wanted.get(name, {f.value}) & {f.value}
            elif name in PUSHED and isinstance(f, In):
                values = {v for v in f.value if v is not None}
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = pafs.FileSystem.from_uri(self.path)
        base = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = store.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else sorted((x for x in store.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
        parts, held = [Files()], 0
        for x in found:
            if held and held + (x.size or 0) > self.pack_bytes:
                parts.append(Files())
                held = 0
            parts[-1].paths.append(f"{base}{x.path}")
            held += x.size or 0
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.int64() if n in ("payload_bytes", "content_length") else pa.binary() if n == "payload" else pa.string()) for n in self.columns])
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            for row in self.records(path):
                rows.append(row)
                held += len(row.get("payload") or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    def records(self, path: str) -> Iterator[dict]:
        store, at = pafs.FileSystem.from_uri(path)
        with store.open_input_file(at) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            for head, block in _packed(stream) if path.endswith(".gz") else _plain(stream):
                if not head:
                    raise ValueError(f"{path}: no record where one is due")
                length = int(head["content-length"])
                every = {c: self.bare(c, head.get(HEADERS[c])) for c in {*self.columns, *self.wanted} if c in HEADERS}
                if any(every[c] not in values for c, values in self.wanted.items()):
                    continue
                row = {c: every[c] for c in self.columns if c in every}
                if "payload_bytes" in row:
                    row["payload_bytes"] = int(row["payload_bytes"] or length)
                if "content_length" in self.columns:
                    row["content_length"] = length
                if "payload" in self.columns:
                    row["payload"] = block()
                yield row

    @staticmethod
    def bare(column: str, value: str | None) -> str | None:
        if value is None:
            return None
        return value.removeprefix("sha1:") if column == "payload_digest" else value.strip("<>") if column in ("record_id", "refers_to") else value


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, str]] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll_bytes: int, gzip: bool):
        self.path, self.roll_bytes, self.gzip = path.rstrip("/"), roll_bytes, gzip

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        archives: list[tuple[str, str]] = []
        out, size = None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload")]
            for i in range(batch.num_rows):
                kind, record_id, uri, date, refers_to, payload = (c[i].as_py() for c in columns)
                payload = payload.encode() if isinstance(payload, str) else payload or b""
                if out is None or size > self.roll_bytes:
                    if out is not None:
                        out.close()
                    name = uuid.uuid4().hex
                    archives.append((f"{root}/.{name}.part", f"{root}/{name}.warc{'.gz' if self.gzip else ''}"))
                    out, size = store.open_output_stream(archives[-1][0]), 0
                data = (packed if self.gzip else bytes)(record(kind, record_id, "".join((uri or "").split()), date, payload, refers_to))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(archives)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = pafs.FileSystem.from_uri(self.path)
        for part, final in (x for m in messages if m for x in m.archives):
            store.move(part, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = pafs.FileSystem.from_uri(self.path)
        for part, _ in (x for m in messages if m for x in m.archives):
            store.delete_file(part)


def register(spark) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, compression: str = "gzip") -> None:
    """Writes a record a row. Of equal payloads of at least least_bytes, the largest id's is the response and the others revisit it.

    Rows that repeat an id and its payload are all responses; a null id counts as the least. Record ids are urn:page: and the id (empty for null).
    """
    register(pages.sparkSession)
    bounded_batches(pages.sparkSession, rows=500)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("long", F.length("payload") >= least_bytes)
    # The join has a small table of digests on its build side; AQE splits the digest that many rows share.
    first = rows.where("long").groupBy("digest").agg(F.max("id").alias("first"))
    joined = rows.join(first.hint("shuffle_hash"), "digest", "left")
    own = ~F.col("long") | F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    joined.select(F.when(own, "response").otherwise("revisit").alias("record_type"), name("id").alias("record_id"), "target_uri", F.lit(date).alias("date"), F.when(~own, name("first")).alias("refers_to"), "payload").write.format("warc").option("compression", compression).mode("append").save(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Writes pages to archives in the shared folder and reads their headers back: id, payload_bytes, payload_digest, record_type, refers_to (an id)."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    archive(pages, path, id_col, **columns)
    kind = pages.schema[id_col].dataType
    bare = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(kind)
    return spark.read.format("warc").schema("record_type string, record_id string, payload_digest string, payload_bytes long, refers_to string").load(path).select(bare("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", bare("refers_to").alias("refers_to"))
