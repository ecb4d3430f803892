"""WARC archives as a PySpark data source, with revisit records for repeated payloads."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewatch.llm.common import small_side

FIELDS = {
    "record_type": "string", "record_id": "string", "target_uri": "string", "page_id": "long", "refers_to": "string",
    "payload_digest": "string", "payload_length": "long", "headers": "map<string,string>", "payload": "binary",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
#: The header behind each field that can be tested before a payload is read.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "page_id": "x-page-id"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "_manifest"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _clean(value: object) -> str:
    return str(value).replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _unclean(value: str) -> str:
    out, it = [], iter(value)
    for c in it:
        out.append({"r": "\r", "n": "\n"}.get(k := next(it, ""), k) if c == "\\" else c)
    return "".join(out)


def encode_record(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record. Line breaks and backslashes in header values are escaped; absent values give no header."""
    kind, payload = row["record_type"], row["payload"] or b""
    block = HTTP_HEAD + payload if kind == "response" else b"" if kind == "revisit" else payload
    names = [
        ("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}"), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None), ("X-Page-ID", row["page_id"]), ("X-Payload-Length", row["payload_length"]),
        ("Content-Type", "application/http; msgtype=response" if kind == "response" else "application/octet-stream"), ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in names if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class FilePart(InputPartition):
    path: str
    size: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Inflated(io.RawIOBase):
    """The members of a gzip file, one after the other, as one stream."""

    def __init__(self, raw):
        self.raw, self.member, self.rest, self.begun = raw, zlib.decompressobj(31), b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.member.eof:
                self.rest, self.member, self.begun = self.member.unused_data, zlib.decompressobj(31), False
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                if self.begun:
                    raise ValueError("the gzip file ends inside a member")
                return 0
            self.begun = True
            got = self.member.decompress(data, len(out))
            self.rest = self.member.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)


def read_records(path: str, wanted: Sequence[tuple[str, frozenset]], fields: Sequence[str], verify: bool = False) -> Iterator[dict]:
    """Records of one file that satisfy all ``wanted`` (header, values). Headers are parsed first; the block of a record that
    is not wanted, or whose payload is not among ``fields``, is stepped over.

    A file that ends inside a record, or holds anything else than records, raises; with ``verify`` so does a payload that is read and
    does not match its digest.
    """
    system, name = _filesystem(path)
    with system.open_input_file(name) as raw:
        packed = name.endswith(".gz")
        f = io.BufferedReader(_Inflated(raw) if packed else raw, 1 << 18)

        size = None if packed else system.get_file_info(name).size

        def cut() -> ValueError:
            return ValueError(f"{path} ends inside a record")

        def skip(n: int) -> None:
            if packed:
                while n:
                    if not (got := len(f.read(min(n, 1 << 18)))):
                        raise cut()
                    n -= got
            elif f.seek(n, 1) > size:
                raise cut()

        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record in {path}")
            head: dict[str, str] = {}
            while line := f.readline():
                if not (line := line.rstrip(b"\r\n")):
                    break
                k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
                head[k.strip().lower()] = _unclean(v.strip())
            else:
                raise cut()
            length = int(head.get("content-length", 0))
            if not all(head.get(k) in values for k, values in wanted):
                skip(length)
                continue
            payload = None
            if "payload" in fields:
                block = f.read(length)
                if len(block) < length:
                    raise cut()
                payload = block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block
                if head.get("warc-type") == "revisit":
                    payload = None
                elif verify and (said := head.get("warc-payload-digest", "")).startswith("sha1:") and said[5:] != hashlib.sha1(payload).hexdigest():
                    raise ValueError(f"{path}: the payload of {head.get('warc-record-id')} does not match its digest")
            else:
                skip(length)
            number = lambda k: int(head[k]) if head.get(k) else None
            digest = head.get("warc-payload-digest")
            values = {
                "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "page_id": number("x-page-id"),
                "refers_to": head.get("warc-refers-to"), "payload_digest": digest.removeprefix("sha1:") if digest else None,
                "payload_length": number("x-payload-length"), "headers": head, "payload": payload,
            }
            yield {k: values[k] for k in fields}


def _manifests(system: pafs.FileSystem, root: str) -> dict[str, dict]:
    out = {}
    for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if x.base_name.startswith(MANIFEST):
            with system.open_input_stream(x.path) as f:
                out[x.base_name] = json.loads(f.read())
    return out


def listed_files(system: pafs.FileSystem, root: str) -> set[str] | None:
    """The files that count in a folder: those of every write whose manifest no later write replaces. None without any manifest."""
    found = _manifests(system, root)
    gone = {name for m in found.values() for name in m["replaces"]}
    return {x for name, m in found.items() if name not in gone for x in m["files"]} if found else None


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.fields = options["path"].rstrip("/"), [f.name for f in schema]
        self.verify = options.get("verify", "false") == "true"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((HEADERS[name], frozenset([str(f.value)])))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((HEADERS[name], frozenset(map(str, f.value))))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [FilePart(self.path, info.size)]
        files = [x for x in system.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith((".warc", ".warc.gz"))]
        listed = listed_files(system, root)
        files = [x for x in files if listed is None or x.base_name in listed]
        return [FilePart(f"{self.path}/{x.base_name}", x.size) for x in sorted(files, key=lambda x: -x.size)]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        shape = pa.schema([(k, kinds[FIELDS[k]]) for k in self.fields])
        if partition is None:  # no file at all
            return
        rows, held = [], 0
        for row in read_records(partition.path, self.wanted, self.fields, self.verify):
            rows.append(row)
            held += 200 + len(row.get("payload") or b"")
            if held > 4 << 20 or len(rows) == 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of about ``file_bytes`` under names of its own; the commit adds a manifest of those of the tasks that
    counted, so files of failed or doubled attempts are never read. Writes add to each other; with ``overwrite`` the manifest also
    says which earlier ones it takes the place of, so readers see either all old records or all new ones."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.packed = options["path"].rstrip("/"), options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    data = encode_record(row)
                    if self.packed:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    out.write(data)
                    size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        said = {"files": [x for m in messages if m for x in m.files], "replaces": sorted(_manifests(system, root)) if self.overwrite else []}
        with system.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(said).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: without a manifest entry no file is read."""


class WarcSource(DataSource):
    """``spark.read.format("warc")``; the fields of ``SCHEMA``, or of a narrower schema, are read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def page_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """A record per page. Of pages with equal payloads of at least ``least`` bytes, that with the largest id is the
    response and the others revisit it; smaller payloads are all responses.

    A null text is an empty payload, a null url gives no header. A page without id is a response unless a page with an id has its payload; if several rows share the largest id and the payload, all of these are responses.
    Payloads move only if the number of repeated payloads is too large to broadcast their digests.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    first = rows.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1 and first is not null").select("payload_digest", "first")
    rows = rows.join(small_side(first), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), "payload_digest", F.lit(">"))).alias("record_id"),
        "target_uri", "page_id", F.when(again, urn(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length",
        F.create_map().cast("map<string,string>").alias("headers"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "none", file_bytes: int = 256 << 20, mode: str = "append") -> None:
    """Write records (the fields of ``SCHEMA``) to ``path``, a folder that all executors share, beside what it holds (``append``) or in
    its place (``overwrite``)."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*FIELDS).write.format("warc").option("compression", compression).option("file_bytes", file_bytes).mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, fields: Sequence[str] = tuple(FIELDS), verify: bool = False) -> DataFrame:
    """Records of a file or folder. One task reads one file. Equality tests on record_type, record_id, target_uri, refers_to and
    page_id are pushed down to the headers; payloads are read only if ``fields`` asks for them. A truncated file raises; with ``verify`` so does
    a payload that was read and does not match its digest."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("verify", str(verify).lower()).schema(", ".join(f"{k} {FIELDS[k]}" for k in fields)).load(path)
