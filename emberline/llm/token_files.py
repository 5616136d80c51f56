"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

One shard holds a run of documents in ascending doc_id order:

    magic | ids | boundaries | document ids | footer (JSON) | footer length (uint32) | magic

Ids take two bytes where the vocabulary allows, else four. The n + 1 document boundaries and the
document ids are monotone, so each is kept as an Elias-Fano sequence: the low bits of every value
packed, the high bits in unary, and the position of every SAMPLE-th one as select directory.
That is about 2 + log2(ids per document) bits a document in place of a 64-bit offset.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .shared import file_system, fresh_dir, partitions, staged
from .token_encoding import encoder

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: Documents and ids of a shard at most, about; a task goes on with another shard. Values whose low bits are packed at once.
SHARD_DOCS, SHARD_IDS, PACKED = 1 << 20, 1 << 30, 1 << 16
#: Documents that one read task takes at a time, and ids read at once.
READ_DOCS, READ_IDS = 20_000, 1 << 22


class EliasFano:
    """A monotone sequence of non-negative integers with O(1)-space select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        packed = [np.packbits(((values[at : at + PACKED, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for at in range(0, n, PACKED)]
        low = np.concatenate(packed)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Values begin to end - 1: select on the high bits from the nearest sample, then the low bits."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        first = begin // SAMPLE
        start = int(self.samples[first]) // 8
        last = min(len(self.samples) - 1, (end - 1) // SAMPLE + 1)
        stop = len(self.high) if (end - 1) // SAMPLE + 1 > last else int(self.samples[last]) // 8 + 1
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self.samples[first])][begin - first * SAMPLE : end - first * SAMPLE]
        high = (ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bit = begin * self.low_bits
        raw = np.unpackbits(self.low[bit // 8 : (end * self.low_bits + 7) // 8], bitorder="little")
        raw = raw[bit % 8 : bit % 8 + (end - begin) * self.low_bits].reshape(end - begin, self.low_bits)
        return high + (raw.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u8").tobytes()]


class ShardWriter:
    """Writes one shard as its documents arrive; only boundaries and document ids stay in memory."""

    def __init__(self, folder: str, wide: bool):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.eft"  # a name for each attempt: a late twin can't replace it
        self.kind = "<u4" if wide else "<u2"
        self.out = self.fs.open_output_stream(f"{root}/{self.name}")
        self.out.write(MAGIC)
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.docs = self.ids = self.nulls = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents in a row, null ids first: the ids of number i are ids[bounds[i] : bounds[i + 1]]."""
        self.out.write(ids.astype(self.kind).tobytes())
        self.lengths.append(np.diff(bounds))
        self.doc_ids.append(doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        self.docs += len(doc_ids)
        self.ids += len(ids)
        self.nulls += doc_ids.null_count

    def close(self) -> dict:
        lengths, doc_ids = np.concatenate(self.lengths), np.concatenate(self.doc_ids)
        bounds = EliasFano.encode(np.concatenate([np.zeros(1, np.uint64), np.cumsum(lengths, dtype=np.uint64)]))
        base = int(doc_ids[0]) if len(doc_ids) else 0
        keys = EliasFano.encode(doc_ids.astype(np.uint64) - np.uint64(base % (1 << 64)))
        footer = {"kind": self.kind, "docs": self.docs, "nulls": self.nulls, "base": base, "sections": []}
        at = len(MAGIC) + self.ids * np.dtype(self.kind).itemsize
        for sequence in (bounds, keys):
            entry = {"n": sequence.n, "low_bits": sequence.low_bits, "parts": []}
            for part in sequence.parts():
                self.out.write(part)
                entry["parts"].append([at, len(part)])
                at += len(part)
            footer["sections"].append(entry)
        raw = json.dumps(footer).encode()
        self.out.write(raw + struct.pack("<I", len(raw)) + MAGIC)
        self.out.close()
        return {"file": self.name, "docs": self.docs, "tokens": self.ids}


class ShardReader:
    """Random access to a shard's documents; reads the footer and the coded sequences only."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is not a complete token file")
        length = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.file.read_at(length, size - len(MAGIC) - 4 - length))
        self.bounds, self.keys = (self._sequence(x) for x in self.footer["sections"])
        self.width = np.dtype(self.footer["kind"]).itemsize

    def _sequence(self, entry: dict) -> EliasFano:
        low, high, samples = (self.file.read_at(n, at) for at, n in entry["parts"])
        return EliasFano(entry["n"], entry["low_bits"], np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u8"))

    def doc_ids(self, begin: int, end: int) -> list[int | None]:
        nulls, base = self.footer["nulls"], self.footer["base"]
        keys = self.keys.slice(max(0, begin - nulls), max(0, end - nulls))
        return [None] * (min(end, nulls) - min(begin, nulls)) + [int(k) + base for k in keys]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end - 1 of the shard's concatenated array."""
        return np.frombuffer(self.file.read_at((end - begin) * self.width, len(MAGIC) + begin * self.width), self.footer["kind"])

    def close(self) -> None:
        self.file.close()


MANIFEST = "part long, file string, docs long, tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every document and write shards in ascending doc_id order; returns the shards' table.

    Null texts count as empty (they hold the end id alone), null doc_ids come first, rows that repeat
    a doc_id follow each other, an empty table gives no shard. A shard is closed once it has `shard_docs` documents or `shard_ids` ids. Further columns are ignored. The
    table has a row per shard: part (its place in the order), file, docs, tokens, start (ids before it).
    """
    folder = folder or fresh_dir(docs.sparkSession, "tokens")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(tokenizer)
        wide, part, writer = max(code.size, end_id + 1) > 1 << 16, TaskContext.get().partitionId() << 32, None
        for batch in batches:
            at = 0
            for ids, bounds in code.encode(batch["text"], end_id):
                writer = writer or ShardWriter(folder, wide)
                writer.add(batch["doc_id"].slice(at, len(bounds) - 1), ids, bounds)
                at += len(bounds) - 1
                if writer.docs >= shard_docs or writer.ids >= shard_ids:
                    yield row(part, writer)
                    part, writer = part + 1, None
        if writer is not None:
            yield row(part, writer)

    def row(part: int, writer: ShardWriter) -> pa.RecordBatch:
        made = writer.close()
        return pa.RecordBatch.from_pylist(
            [{"part": part, "file": f"{folder.rstrip('/')}/{made['file']}", "docs": made["docs"], "tokens": made["tokens"]}],
            schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = staged(ordered.mapInArrow(lean(shard, "encoders"), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32 and the shard's file."""
    spark = shards.sparkSession
    blocks = shards.select(
        "file", "start", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first")
    ).repartition(max(1, partitions(spark)), "file", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["file"])
                first, last = row["first"], min(row["first"] + READ_DOCS, row["docs"])
                bounds = shard.bounds.slice(first, last + 1).astype(np.int64)
                crcs, at = [], 0
                while at < last - first:  # as many documents as fit in READ_IDS, one at least
                    upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + READ_IDS, "right")) - 1)
                    if bounds[upto] - bounds[at] <= READ_IDS:
                        raw = shard.ids(int(bounds[at]), int(bounds[upto])).astype("<u4").tobytes()
                        cuts = (4 * (bounds[at : upto + 1] - bounds[at])).tolist()
                        crcs += [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                    else:
                        crc = 0
                        for a in range(int(bounds[at]), int(bounds[upto]), READ_IDS):
                            crc = zlib.crc32(shard.ids(a, min(a + READ_IDS, int(bounds[upto]))).astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    at = upto
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids(first, last), pa.int64()),
                        pa.array(bounds[:-1] + row["start"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(crcs, pa.int64()),
                        pa.array([row["file"]] * (last - first), pa.string()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )
                shard.close()

    return blocks.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
