"""WARC archives: writing, normalising monolithic gzip files, reading by index.

Some writers compress a whole WARC file as one gzip stream, which no reader can seek in. The
normaliser inflates such a stream once, front to back, finds the records by their lengths,
rewrites each as a gzip member of its own and writes a sidecar index of their offsets.

Archives are files in a folder all executors share (any URI that pyarrow's file systems open).
A file's name has the number of its partition and a random part, so the file of an attempt that
is lost is never read: only committed attempts report their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shelf, table

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20
NO_ID = "none"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == NO_ID else int(name)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit: the same HTTP headers (they state the payload's length) without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}"}
    if url is not None:
        named["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        named |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    named |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items())
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an uncompressed stream, holding one record at a time."""
    rest = bytearray()

    def fill() -> bool:
        more = stream.read(CHUNK)
        rest.extend(more)
        return bool(more)

    while True:
        while (end := rest.find(b"\r\n\r\n")) < 0:
            if not fill():
                if rest.strip():
                    raise ValueError("the archive ends inside a record")
                return
        head = parse_head(bytes(rest[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(rest) < size:
            if not fill():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(rest[:size])
        del rest[:size]


def normalise(files: fs.FileSystem, source: str, target: str) -> list[dict]:
    """Rewrite ``source`` (one gzip stream, or several members) as one member a record; the entries of
    the sidecar index, which goes to ``target`` + ".idx" as JSON lines."""
    index, at = [], 0
    with files.open_input_stream(source, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, files.open_output_stream(target, compression=None) as out:
        for head, record in records(plain):
            member = gzip.compress(record, 6, mtime=0)
            out.write(member)
            index.append({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]})
            at += len(member)
    with files.open_output_stream(f"{target}.idx", compression=None) as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return index


def read_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member."""
    record = zlib.decompress(member, wbits=31)
    end = record.index(b"\r\n\r\n")
    head = parse_head(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}")
    return files, path


def marked(pages: DataFrame, shelf: Shelf, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to: which record stands for each payload.

    Groups of equal payloads are kept as a table of those with several rows only, so the join is
    with few rows: broadcast if their measured size allows, else split by adaptive execution.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("key"), F.octet_length(payload).alias("size"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    groups = shelf.keep(groups.withColumn("found", F.lit(True)), "groups")
    joined = rows.join(groups, ["key", "size"], "left")
    revisit = F.col("found").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the rows of ``marked`` as monolithic gzip WARC files; the names of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        name, out, packed, size = None, None, None, 0

        def close() -> pa.RecordBatch:
            packed.close(), out.close()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

        for b in batches:
            for page, url, text, revisit, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(posixpath.join(path, name), compression=None)
                    packed = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0)
                payload = text.encode()
                record = make_record(page, url, payload, sha1_base32(payload), first, revisit)
                packed.write(record)
                size += len(record)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, "archive string")


def normalise_archives(archives: DataFrame, folder: str, drop: bool = False) -> DataFrame:
    """Normalise the archives (column ``archive``) of ``folder``: archive, offset, length of every record.

    ``drop`` deletes an archive once its normalised copy is complete; a rerun then takes that copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                source, target = posixpath.join(path, name), posixpath.join(path, f"records-{name}")
                if files.get_file_info(source).type == fs.FileType.NotFound:
                    with files.open_input_stream(f"{target}.idx", compression=None) as f:
                        index = [json.loads(x) for x in f.read().splitlines()]
                else:
                    part = f"{target}-{uuid.uuid4().hex}"
                    index = normalise(files, source, part)
                    files.move(f"{part}.idx", f"{target}.idx"), files.move(part, target)
                    if drop:
                        files.delete_file(source)
                yield pa.RecordBatch.from_arrays([pa.array([f"records-{name}"] * len(index)), pa.array([x["offset"] for x in index], pa.int64()), pa.array([x["length"] for x in index], pa.int64())], names=["archive", "offset", "length"])

    return archives.mapInArrow(run, "archive string, offset long, length long")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record the index names: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        name, f = None, None
        for b in batches:
            rows: list[tuple] = []
            for archive, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    name, f = archive, files.open_input_file(posixpath.join(path, archive))
                f.seek(at)
                head, http, payload = read_record(f.read(size))
                revisit = head["warc-type"] == "revisit"
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and sha1_base32(payload) != digest:
                    raise ValueError(f"{archive} at {at}: the payload doesn't have its digest")
                refers = page_of(head["warc-refers-to"]) if revisit else None
                rows.append((page_of(head["warc-record-id"]), int(http["content-length"]), digest, head["warc-type"], refers, None if revisit else payload))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC, normalise the archives, read every record back by the index.

    Of records with equal payloads of at least ``least_bytes``, the smallest id is the response and
    the others revisit it. Null payloads are empty ones. Rows without id are revisits wherever the
    payload has a row with an id, else responses; rows that repeat the smallest id are responses
    each. An empty table gives no archive and no row. Other columns are ignored.
    """
    shelf = Shelf(pages.sparkSession, "warc")
    folder = f"{shelf.path}/archives"
    names = shelf.keep(write_archives(marked(pages, shelf, id_col, url_col, payload_col, least_bytes), folder), "names")
    index = shelf.keep(normalise_archives(names.repartition(max(1, names.count())), folder, drop=True), "index")
    return read_archives(index, folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload")


#: Base32 of the 40 hexadecimal digits: each 5 digits are 20 bits, so 4 letters.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
g AS (SELECT hex, payload_bytes, min(page_id) AS first FROM h GROUP BY ALL)
SELECT h.page_id, h.payload_bytes::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h.hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN h.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN h.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM h JOIN g ON h.hex = g.hex AND h.payload_bytes = g.payload_bytes
"""
