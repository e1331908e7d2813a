"""WARC archives, index first.

`write_archives` writes one gzip member per record into archives below a shared folder and returns the
index: offset, length, URL and digest of each record. `read_records` takes any selection of index
rows, sorts it by place, and turns neighbouring ranges into one read.

Of records with equal payloads of at least `MIN_REVISIT` bytes, that with the smallest page_id is a
response and the others revisit it; smaller ones are all responses. A task writes archives under names
of its own attempt, and only the index rows of attempts that Spark commits name an archive, so a lost
executor leaves at most files that nothing refers to.

Defined cases: a null html is an empty payload; a null url has no WARC-Target-URI; rows with equal
payload that share the smallest page_id are all responses; a null page_id is larger than any other, and
if all ids of a payload are null, all are responses. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
#: Ranges with at most this gap are read at once, up to this many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
#: Bytes of archives that a task reads, about, and length of the cuts of an archive that tasks share out.
TASK_BYTES = 32 << 20
CUT_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "page_id bigint, archive string, offset bigint, length bigint, url string, payload_digest string, record_type string"
)
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the mounted one for a plain path."""
    if re.match(r"\w[\w+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def marked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and size of the payload, and the response that a page revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    origins = (
        rows.filter(F.col("size") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("origin"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "origin")
    )
    revisits = (F.col("origin") < F.col("page_id")) | (F.col("origin").isNotNull() & F.col("page_id").isNull())
    return rows.join(origins, "digest", "left").select(
        "page_id", "url", "html", "digest", "size", F.when(revisits, F.col("origin")).alias("refers_to")
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    number = record_id[len("<urn:x-page:") : -1]
    return None if number == "none" else int(number)


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole WARC record."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        # A line break in a URL must not end the header.
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", _PROFILE)]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + payload + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    head, _, body = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    payload = body[: int(fields["Content-Length"])]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": None if url is None else re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), url),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload,
    }


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        yield {c: batch.column(c)[at].as_py() for c in batch.schema.names}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page below `folder`; the result, once it is saved, is the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        rows = (row for batch in batches for row in _rows(batch))
        row = next(rows, None)
        while row is not None:
            system.create_dir(base, recursive=True)
            name, offset, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                while row is not None and offset < ARCHIVE_BYTES:
                    record = render(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"])
                    member = gzip.compress(record, compresslevel=6, mtime=0)
                    out.write(member)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    index.append((row["page_id"], name, offset, len(member), row["url"], row["digest"], kind))
                    offset += len(member)
                    row = next(rows, None)
            # Index rows leave only once their archive is closed.
            columns = [pa.array(v, t) for v, t in zip(zip(*index, strict=True), _INDEX_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, _INDEX_NAMES)

    return marked_pages(pages).mapInArrow(run, _INDEX)


_INDEX_NAMES = [part.split()[0] for part in _INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if part.endswith("bigint") else pa.string() for part in _INDEX.split(", ")]


def _ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads of sorted (offset, length) ranges: start, end and the ranges inside."""
    inside: list[tuple[int, int]] = []
    for offset, length in places:
        if inside:
            start, end = inside[0][0], sum(inside[-1])
            if offset - end > GAP_BYTES or offset + length - start > READ_BYTES:
                yield start, end, inside
                inside = []
        inside.append((offset, length))
    if inside:
        yield inside[0][0], sum(inside[-1]), inside


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows, read from the archives in order of their place.

    The number of tasks follows from the bytes that are read, not from the size of the index, and an archive is read by
    several of them, cut by cut.
    """
    places = index.select("archive", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    cut = F.expr(f"offset div {CUT_BYTES}")
    placed = places.repartition(max(1, -(-total // TASK_BYTES)), "archive", cut).sortWithinPartitions("archive", "offset")
    schema = _RECORD + (", payload binary" if with_payload else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            at = 0
            while at < len(archives):
                stop = at
                while stop < len(archives) and archives[stop] == archives[at]:
                    stop += 1
                with system.open_input_file(f"{base}/{archives[at]}") as file:
                    for start, end, inside in _ranges(list(zip(offsets[at:stop], lengths[at:stop], strict=True))):
                        data = file.read_at(end - start, start)
                        rows = [parse(zlib.decompress(data[o - start : o - start + n], wbits=31)) for o, n in inside]
                        columns = [pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names)
                at = stop

    return placed.mapInArrow(run, schema)
