"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Records follow WARC/1.1: a version line, named fields, an empty line, the block, two line ends. ``derive`` reads response
records (of ``read_warc`` or any other source) and makes for each a metadata record (source headers, title, links) and a conversion record (the
page's text). Both refer to the response by WARC-Refers-To, keep its target and date, and carry digests of their own blocks;
the metadata record repeats the source's HTTP headers and payload digest. Record ids are derived from the response's id, so a
task that runs again makes the same records. Each record is made where its response is read: there is no shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sources import stores
from . import common
from .html_extract import SILENT, blocks, parse, walk

DATE = "2024-01-01T00:00:00Z"
#: Names under which record ids are derived.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\b|\Z)", re.I | re.S)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(names))}>"


def clean(value: str) -> str:
    """A field's value on one line."""
    return " ".join(value.split())


def make_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {clean(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The fields by lower-case name (the first of several), and the block, of one record. A length that is no number, or more
    than there is, is that of the rest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    said = fields.get("content-length", "")
    return fields, rest[: int(said)] if said.isascii() and said.isdigit() else rest.removesuffix(b"\r\n\r\n")


def _dechunked(body: bytes) -> tuple[bytes, str]:
    whole, rest = [], body
    while rest:
        size, _, rest = rest.partition(b"\r\n")
        try:
            n = int(size.split(b";")[0].strip(), 16)
        except ValueError:
            return b"".join([*whole, size, rest]) if not whole else b"".join(whole), "bad chunk size"
        if n < 0 or n > len(rest):
            return b"".join([*whole, rest]), "cut-off chunk"
        if not n:
            break
        whole.append(rest[:n])
        rest = rest[n + 2 :]
    return b"".join(whole), ""


def _unpacked(body: bytes, coding: str) -> tuple[bytes, str]:
    if coding in ("", "identity"):
        return body, ""
    for way in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        out, unpacker = [], zlib.decompressobj(way)
        try:
            out.append(unpacker.decompress(body))
            return b"".join([*out, unpacker.flush()]), "" if unpacker.eof else f"cut-off {coding}"
        except zlib.error:
            continue
    return body, f"not decoded: {coding}"


def read_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, str]:
    """Status line, headers in order and the decoded body of an HTTP response, and what went wrong with it ('' if nothing did:
    a body that can't be decoded is left as it is)."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()]
    named: dict[str, list[str]] = {}
    for k, v in headers:
        named.setdefault(k.lower(), []).extend(x.strip().lower() for x in v.split(","))
    wrong = []
    # codings were put on in the order in which they stand, so the last one comes off first
    for coding in reversed(named.get("transfer-encoding", [])):
        body, error = _dechunked(body) if coding == "chunked" else _unpacked(body, coding)
        wrong.append(error)
    for coding in reversed(named.get("content-encoding", [])):
        body, error = _unpacked(body, coding)
        wrong.append(error)
    return lines[0], headers, body, "; ".join(x for x in wrong if x)


def decoded(body: bytes, headers: list[tuple[str, str]]) -> str:
    types = " ".join(v for k, v in headers if k.lower() == "content-type")
    said = _CHARSET.search(types.encode("latin-1", "replace")) or _CHARSET.search(body[:2048])
    try:
        return body.decode(said.group(1).decode("ascii") if said else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def response_record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return make_record("response", fields, http + payload)


def derive(raw: bytes) -> tuple[dict[str, str], bytes, bytes, int, str]:
    """Of a response record: its fields, the metadata record, the conversion record, how many links the page has, and what was
    wrong with the record, if anything: it never ends the job, and the derived records are of what could be read."""
    fields, block = read_record(raw)
    status, headers, body, error = read_http(block)
    said = fields.get("content-length", "")
    if not (said.isascii() and said.isdigit()) or int(said) > len(block):
        error = "; ".join(x for x in ("bad record length", error) if x)
    page = decoded(body, headers)
    source = fields.get("warc-record-id", "")
    shared = [("WARC-Date", fields.get("warc-date", "")), ("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Refers-To", source)]
    title = _TITLE.search(page)
    links = [m.strip("\"'") for m in _LINK.findall(page)]
    said = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", fields.get("warc-payload-digest", "")), ("source-content-length", fields.get("content-length", "")), ("title", title.group(1) if title else ""), *(("outlink", x) for x in links)]
    metadata = "".join(f"{k}: {clean(v)}\r\n" for k, v in said).encode("utf-8", "surrogatepass")
    text = "\n".join(blocks([parse(page)], lambda node: node.tag in SILENT)).encode("utf-8", "surrogatepass")
    return (
        fields,
        make_record("metadata", [("WARC-Record-ID", record_id("metadata", source)), *shared, ("Content-Type", "application/warc-fields")], metadata),
        make_record("conversion", [("WARC-Record-ID", record_id("conversion", source)), *shared, ("WARC-Source-Payload-Digest", fields.get("warc-payload-digest", "")), ("Content-Type", "text/plain; charset=utf-8")], text),
        len(links),
        error,
    )


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, url and record, a WARC response of each row of pages; a null page is empty, a null url ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 128):
            made = [response_record(*x, date) for x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["page_id", "url", "record"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, record binary")


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row of records (key, record: a WARC response): key, response_id, metadata and conversion (whole records), n_links,
    error (null if the record was sound).

    Rows with a null record are left out; an empty record has an error and empty derivatives. Repeated rows each give records
    (with the same ids if the response's id is the same). Records of any length are read whole. An empty table gives no rows;
    other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.pieces(batches, 128):
            made = [derive(x.as_py()) for x in some.column(1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x[0].get("warc-record-id", "") for x in made]), pa.array([x[1] for x in made], pa.binary()), pa.array([x[2] for x in made], pa.binary()), pa.array([x[3] for x in made], pa.int64()), pa.array([x[4] or None for x in made], pa.string())], [key, "response_id", "metadata", "conversion", "n_links", "error"])

    return records.select(key, "record").filter(F.col("record").isNotNull()).mapInArrow(run, f"`{key}` {records.schema[key].dataType.simpleString()}, response_id string, metadata binary, conversion binary, n_links long, error string")


def records_of(stream) -> Iterator[tuple[int, bytes, str | None]]:
    """Number, bytes and error of each record of a WARC file (gzipped ones: members, one record or more in each). What follows a
    place that is no record, or is cut off, is one row with an error, and the file ends there."""
    head = stream.peek(2)[:2] if hasattr(stream, "peek") else b""
    if head == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    number = 0
    while True:
        lines, at = [], b""
        try:
            while (at := stream.readline()) in (b"\r\n", b"\n"):
                pass
            if not at:
                return
            while at not in (b"\r\n", b"\n", b""):
                lines.append(at)
                at = stream.readline()
            sizes = [x.partition(b":")[2].strip() for x in lines if x[:15].lower() == b"content-length:"]
            if not lines[0].startswith(b"WARC/") or not at or not sizes or not sizes[0].isdigit():
                yield number, b"".join([*lines, at]), "no record"
                return
            block = stream.read(int(sizes[0]))
        except (EOFError, OSError, zlib.error) as e:
            yield number, b"".join(lines), f"cut off: {e}"
            return
        short = len(block) < int(sizes[0])
        yield number, b"".join([*lines, at, block, b"\r\n\r\n"]), "cut off" if short else None
        if short:
            return
        number += 1


class _Files(DataSourceReader):
    def __init__(self, uris: list[str]):
        self.uris = uris

    def partitions(self):
        return [InputPartition(u) for u in self.uris]

    def read(self, partition):
        with stores.open_uri(partition.value) as raw:
            for number, record, error in records_of(io.BufferedReader(raw)):
                kind = re.search(rb"(?im)^WARC-Type:[ \t]*([^\r\n]*)", record[:65536])
                yield partition.value, number, kind.group(1).decode("latin-1").strip() if kind else None, record, error


class WarcSource(DataSource):
    """``spark.read.format("warc").load(...)`` after ``register``: file, number, type, record, error of WARC files, plain or
    gzipped, a partition a file. Option path: one, or several parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "file string, number long, type string, record binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Files([u for u in self.options.get("path", "").split(",") if u])


def read_warc(spark: SparkSession, pattern: str) -> DataFrame:
    """The records of all WARC files that a path or pattern of any file system names."""
    spark.dataSource.register(WarcSource)
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    uris = sorted(stores.qualified(spark, x.getPath().toString()) for x in found)
    if not uris:
        raise FileNotFoundError(pattern)
    return spark.read.format("warc").load(",".join(uris))


def write_warc(records: DataFrame, folder: str, column: str = "record") -> DataFrame:
    """One gzipped WARC file a partition, a member a record, under folder (on a store that pyarrow's file systems open and all
    executors reach). A file appears whole or not at all and a second run of a task replaces it. Returns file and n_records."""

    folder = stores.qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = stores.file_system(folder)
        store.create_dir(root, recursive=True)
        name, n = f"{root}/part-{task.partitionId():05d}.warc.gz", 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None) as out:
            for batch in batches:
                for x in batch.column(0):
                    if x.is_valid:
                        out.write(gzip.compress(x.as_py(), 6, mtime=0))
                        n += 1
        store.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n_records"])

    return records.select(column).mapInArrow(run, "file string, n_records long")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, ids of the three records, links, length and digest of the derived records, and error. Nulls, repeated
    rows, empty tables and further columns as in ``responses`` and ``derivatives``."""
    return described(derivatives(responses(common.table(spark, sf_dir, "pages"))))


def described(made: DataFrame) -> DataFrame:
    """Of what derivatives() returns: ids, links, and length and digest of the records."""
    # the fields end at the first empty line, wherever that is
    head = lambda c: F.concat(F.substring_index(F.decode(c, "ISO-8859-1"), "\r\n\r\n", 1), F.lit("\r\n"))
    field = lambda name, c: F.regexp_extract(head(c), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return made.select(
        "page_id",
        "response_id",
        field("WARC-Record-ID", F.col("metadata")).alias("metadata_id"),
        field("WARC-Record-ID", F.col("conversion")).alias("conversion_id"),
        field("WARC-Refers-To", F.col("conversion")).alias("refers_to"),
        "n_links",
        F.octet_length("metadata").cast("long").alias("metadata_bytes"),
        F.sha2("metadata", 256).alias("metadata_sha256"),
        F.octet_length("conversion").cast("long").alias("conversion_bytes"),
        F.sha2("conversion", 256).alias("conversion_sha256"),
        "error",
    )
