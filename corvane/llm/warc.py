"""WARC archives: one gzip member for each record, written and read as streams.

Writing: tasks append records to archives of bounded size in a folder that all executors share; equal payloads are stored
once, later ones as revisit records. The list of finished archives is itself written before anything reads it, so archives
of lost or repeated task attempts are never read. Reading: each archive is read from front to back with incremental zlib
decompression, records are framed by Content-Length, and payload digests are verified.

Defined results: a null payload is empty; a null page_id is written as such and read back as null, and is never the target
of a revisit; rows that repeat the largest page_id of a payload are responses too; control characters of a URL are
percent-encoded in its header and come back as they were; extra columns are ignored; an empty table gives no archive and no
rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, stored

#: Equal payloads of fewer bytes are all stored.
MIN_REVISIT = 1000
#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
#: Up to so many repeated payloads (28 bytes each) their table is sent to all tasks; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
_CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that doesn't keep to its framing or digest."""


#: Schemes of Hadoop's file systems, by the name that Arrow gives to the same storage.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss"}


def arrow_uri(uri: str) -> str:
    scheme, sep, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{sep}{rest}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI, and the path inside it; tasks have no Hadoop classes of their own."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def header_text(value: str) -> str:
    """A value that stays one header line: control characters, blanks at the ends and ``%`` itself are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f%  ]|^\s+|\s+$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def from_header(value: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), value)


def record(kind: str, uri: str, page_id: int | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit has no block; its payload's digest and length stand in the header."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {header_text(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {length}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: IO[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed pieces of bounded size."""
    rest = stream.read(_CHUNK)
    while rest:
        z = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not z.eof:
                if not rest and not (rest := stream.read(_CHUNK)):
                    raise WarcError("archive ends inside a member")
                out = z.decompress(rest, _CHUNK)
                rest = z.unconsumed_tail if not z.eof else z.unused_data
                if out:
                    yield out

        part = pieces()
        yield part
        for _ in part:  # what the caller left
            pass
        rest = rest or stream.read(_CHUNK)


def read_records(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; framing and payload digests are verified."""
    for part in members(stream):
        buffer = bytearray()
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(part, None)
            if piece is None:
                raise WarcError("record without an end of its header")
            buffer += piece
        lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("record without a version line")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        del buffer[: end + 4]
        for piece in part:
            buffer += piece
        if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
            raise WarcError("Content-Length doesn't frame the block")
        block = bytes(buffer[:length])
        if head["warc-type"] == "response" and "sha1:" + hashlib.sha1(block).hexdigest() != head["warc-payload-digest"]:
            raise WarcError("payload digest differs")
        yield head, block


def plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest and ``refers_to``: the largest page_id with the same payload, if that is another row."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= min_revisit
    # Counts are combined in the tasks first, so a payload that many pages share costs one row for each task.
    repeated = rows.where(large).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("target")).where("n > 1 and target is not null")
    repeated = stored(repeated.select("digest", "target"), "warc-repeated")
    if repeated.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        salts = 32  # so that the pages of one payload are dealt over so many tasks
        left = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
        right = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = left.join(right, ["digest", "salt"], "left")
    other = F.col("target").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("target")))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("target")).alias("refers_to"))


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` (a URI all executors reach); the list of finished ones: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        fs, root = file_system(folder)
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                one = record(kind, url, page_id, payload if refers_to is None else b"", digest, len(payload), refers_to)
                out.write(member(one))
                n, size = n + 1, size + len(one)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        scheme = folder.partition("://")[0]
        head = folder[: len(folder) - len(root)] if folder.endswith(root) else f"{scheme}://"
        yield pa.RecordBatch.from_pydict({"path": pa.array([head + p for p, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    return stored(planned.mapInArrow(run, "path string, records long"), "warc-manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest``; an archive is read by one task."""

    def rows(path: str) -> Iterator[tuple]:
        fs, name = file_system(path)
        with fs.open_input_stream(name, compression=None) as stream:
            for head, block in read_records(stream):
                number = lambda k: (int(x) if (x := head.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None)
                kind = head["warc-type"]
                size = len(block) if kind == "response" else int(head["warc-payload-length"])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                yield number("warc-record-id"), from_header(head["warc-target-uri"]), size, digest, kind, number("warc-refers-to"), block if payload else None

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(min(files, 20_000)).mapInArrow(run, RECORDS)


def report(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, one row per page."""
    spark = pages.sparkSession
    manifest = write(plan(pages), shared_path(spark, "warc"))
    return read(spark, manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
