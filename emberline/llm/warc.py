"""WARC archives: one gzip member per record, read back by byte ranges.

A reading task gets a byte range, not a file. It looks for gzip magic inside its range, takes the
first candidate whose decoded head is a WARC header, and from there follows member ends. It owns every
record that starts inside its range and reads on beyond the range's end to finish the last one, so
each record has exactly one owner, whatever the ranges.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, fresh_dir, partitions, staged

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Decoded bytes that validate a candidate, and bytes that are read at once.
PROBE, READ = 512, 1 << 20
#: A written file is closed after so many bytes; a reading task gets a range of so many.
FILE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
GZIP_LEVEL = 4


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def _looks_like_record(raw: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(raw, PROBE).startswith(b"WARC/1.")
    except zlib.error:
        return False


class _Bytes:
    """A file read forwards in blocks."""

    def __init__(self, uri: str, at: int):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        self.size, self.at = self.file.size(), at

    def next(self) -> bytes:
        raw = self.file.read_at(min(READ, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(raw)
        return raw


def first_record(uri: str, begin: int, end: int) -> int | None:
    """Where the first record starts in [begin, end), if one does."""
    source = _Bytes(uri, begin)
    held, held_at = b"", begin
    while True:
        more = source.next()
        held += more
        at = held.find(MAGIC)
        while at >= 0 and held_at + at < end and (len(held) - at >= 8 * PROBE or not more):
            if _looks_like_record(held[at:]):
                return held_at + at
            at = held.find(MAGIC, at + 1)
        if at < 0:
            at = max(0, len(held) - len(MAGIC) + 1)
        held, held_at = held[at:], held_at + at
        if not more or held_at >= end:
            return None


def records(uri: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each record that starts in [begin, end)."""
    start = first_record(uri, begin, end)
    if start is None:
        return
    source, held = _Bytes(uri, start), b""
    while start < end:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = source.next()
                if not held:
                    if used:
                        raise ValueError(f"{uri}: the record at {start} is cut off")
                    return
            parts.append(unpacker.decompress(held))
            used += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        yield start, b"".join(parts)
        start += used


def find_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages as page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Digests are counted before any payload moves; only digests that recur reach the join, whose
    hot keys adaptive execution splits.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    recurring = (
        full.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )
    joined = full.join(staged(recurring, "recurring-payloads"), "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page and return the files' table (file, bytes, records).

    Of pages with equal payloads of at least `min_bytes` bytes the one with the smallest page_id is
    a response and the others are revisits of it; rows that repeat that smallest page_id are
    responses too, and pages whose page_id is null are revisits of a page that has one. A null html is an
    empty payload, a null url leaves the target out, one with control characters or outer blanks is
    percent-encoded. An empty table gives no file; further columns are ignored.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, made, size, count = None, [], 0, 0
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)

        def close() -> None:
            out.close()
            made.append({"file": f"{folder.rstrip('/')}/{name}", "bytes": size, "records": count})

        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"))):
                page_id, url, payload, n, digest, kind, refers = (x.as_py() for x in row)
                headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if url is not None:
                    headers.append(("WARC-Target-URI", url if url.isprintable() and url == url.strip() else quote(url)))
                if kind == "revisit":
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("X-Payload-Length", str(n))]
                member = encode_record(headers, HTTP_HEAD + (payload if kind == "response" else b""))
                if out is None:  # a name for each attempt: a late twin can't replace a file already listed
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return staged(find_revisits(pages, min_bytes).mapInArrow(write, "file string, bytes long, records long"), "warc-files")


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(value) if value.lstrip("-").isdigit() else None


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Read archives by byte ranges; a row per record.

    A response's length and digest are taken from its payload, which must match the digest its header
    gives; a revisit has no payload, so both come from its header.
    """
    ranges = files.select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("begin")
    ).repartition(max(1, partitions(files.sparkSession)), "file", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                for offset, raw in records(row["file"], row["begin"], min(row["bytes"], row["begin"] + range_bytes)):
                    cut = raw.index(b"\r\n\r\n") + 4
                    head = decode_head(raw[: cut - 4])
                    block = memoryview(raw)[cut : cut + int(head["content-length"])]
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if head["warc-type"] == "response":
                        payload = block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :]
                        length = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{row['file']}: the payload at {offset} does not match its digest")
                    else:
                        length = int(head["x-payload-length"])
                    found.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), length, digest, head["warc-type"], _page(head.get("warc-refers-to")), row["file"], offset))
                if found:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    names = [x.split()[0] for x in RECORDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return ranges.mapInArrow(read, RECORDS)
