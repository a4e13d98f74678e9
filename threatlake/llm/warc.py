"""Operator 8, WARC: archives written with an index first, read by coalesced byte ranges.

Writing: equal payloads are grouped by their SHA-1; the smallest page id of a
group is the response, the others are revisit records that refer to it
(payloads below ``revisit_from`` bytes are always responses).  Every task
streams its records, each a gzip member of its own, into archive files of
bounded size in the shared folder, and emits one index row per record: file,
offset, length, URL, digest.  A task that is tried again writes new files, and
only the committed try's index rows are kept, so lost executors do no harm.

Reading: the selected index rows are dealt by file and sorted by offset; ranges
that touch or lie close together are read in one request of bounded size.

Results in edge cases: a null html is an empty payload; a null or empty URL and
a null id are written as an empty header and read back as null; line ends in a
URL are percent-encoded; rows with the same id and
payload are all responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_path, shuffle_width, written

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.0 record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {'' if url is None else url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record's fields; raises ValueError if lengths or digests do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    length = int(fields["Content-Length"])
    body = rest[:length]
    if lines[0] != "WARC/1.0" or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError("the payload does not have its digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"] or None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload": body if kind == "response" else None,
    }


def with_originals(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(page_id, url, payload, first_id): ``first_id`` is the smallest id with the payload, for repeated payloads only."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    large = rows.where(F.octet_length("payload") >= revisit_from)
    firsts = large.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select(F.col("sha").alias("_sha"), "first_id"), "warc-firsts")
    # a page with a payload of its own never meets the table of repeated ones, so only those rows can crowd a key
    joined = rows.join(firsts, (F.col("sha") == F.col("_sha")) & (F.octet_length("payload") >= revisit_from), "left")
    return joined.select("page_id", "url", "payload", "first_id")


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives below ``folder`` and returns their index, itself written there."""
    spark = pages.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers_to = first if first is not None and first != page_id else None
                member = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to), 1, mtime=0)
                out.write(member)
                index.append((name, offset, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                offset += len(member)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in index], kind) for k, kind in enumerate(kinds)], names=names)
        if out is not None:
            out.close()

    index = with_originals(pages, revisit_from).mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(rows: Iterator[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) to requests (file, start, [(offset, length)]) of about ``read_bytes`` at most."""
    name, start, end, parts = None, 0, 0, []
    for file, offset, length in rows:
        if parts and (file != name or offset - end > gap or offset + length - start > read_bytes):
            yield name, start, parts
            parts = []
        if not parts:
            name, start, end = file, offset, offset
        parts.append((offset, length))
        end = max(end, offset + length)
    if parts:
        yield name, start, parts


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the ``selected`` index rows, read from the archives by coalesced ranges."""
    width = shuffle_width(selected.sparkSession)
    planned = selected.select("file", "offset", "length").repartition(width, "file").sortWithinPartitions("file", "offset")
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        if not with_payload:
            kinds.pop("payload")
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        name, source = None, None
        for file, start, parts in coalesced(rows):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, store.open_input_file(f"{root}/{file}")
            block = source.read_at(parts[-1][0] + parts[-1][1] - start, start)
            records = [parse_record(gzip.decompress(block[o - start : o - start + n])) for o, n in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], kind) for k, kind in kinds.items()], names=list(kinds))
        if source is not None:
            source.close()

    return planned.mapInArrow(read, schema)


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
