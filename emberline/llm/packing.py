"""Packing documents into fixed-size token sequences: dominance reduction, then best fit.

Pieces have one of `capacity` lengths, so the packing is solved on the histogram of lengths, whose
size is bounded by `capacity` whatever the corpus holds. Its solution is a table of steps: the
pieces of one length and a range of ranks go, one each, to a range of sequences at one offset. Spark
then ranks the pieces within their length and looks each up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .shared import staged
from .token_encoding import encoder


class Plan:
    """Steps (length, first rank, count, first sequence, offset) and the pieces still unplaced."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        if any(not 0 < length <= capacity for length in histogram):
            raise ValueError("lengths must be from 1 to the capacity")
        self.capacity = capacity
        self.left = {k: v for k, v in sorted(histogram.items()) if v > 0}
        self.rank: dict[int, int] = defaultdict(int)
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def place(self, length: int, count: int, first: int, offset: int) -> None:
        self.steps.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], count: int) -> None:
        """`count` sequences that each hold one piece of every length given (a length may repeat)."""
        offset = 0
        for length in lengths:
            self.place(length, count, self.sequences, offset)
            offset += length
        self.sequences += count
        self.fixed += count


def reduce_by_dominance(plan: Plan) -> None:
    """Martello and Toth's reduction: permanently fix sets that no alternative beats.

    For the piece j in hand and the room left beside it: (a) nothing fits, so j stays alone;
    (b) a piece fills the room exactly, and could replace whatever else would stand beside j;
    (c) one piece at most fits, so the largest that does; (d) two at most fit and the largest single
    piece is no smaller than the best pair, so again that piece. Each is repeated, with
    the pieces so removed gone, until nothing changes.
    """
    changed = True
    while changed and plan.left:
        before = plan.fixed
        for length in sorted(plan.left, reverse=True):
            while plan.left.get(length):
                room = plan.capacity - length
                sizes = sorted(plan.left)
                free = lambda s: plan.left.get(s, 0) - (s == length)
                smallest = next((s for s in sizes if free(s) > 0), None)
                if smallest is None or smallest > room:
                    plan.fix([length], plan.left[length])
                    continue
                mate = None
                if free(room) > 0:
                    mate = room
                else:
                    few = []
                    for s in sizes:
                        few += [s] * min(3 - len(few), max(0, free(s)))
                        if len(few) == 3:
                            break
                    at = bisect_left(sizes, room + 1) - 1
                    while at >= 0 and free(sizes[at]) <= 0:
                        at -= 1
                    best = sizes[at]
                    if sum(few[:2]) > room or len(few) < 2:
                        mate = best
                    elif len(few) < 3 or sum(few) > room:
                        usable = [s for s in sizes if s <= room and free(s) > 0]
                        low, high, pair = 0, len(usable) - 1, 0
                        while low <= high:
                            if usable[low] + usable[high] > room:
                                high -= 1
                            else:
                                if low != high or free(usable[low]) > 1:
                                    pair = max(pair, usable[low] + usable[high])
                                low += 1
                        if best >= pair:
                            mate = best
                if mate is None:
                    break
                plan.fix([length, mate], plan.left[length] // 2 if mate == length else min(plan.left[length], plan.left[mate]))
        changed = plan.fixed > before


def best_fit(plan: Plan) -> None:
    """Best fit, longest first, on runs of sequences that hold the same lengths."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def open_run(room: int, first: int, count: int) -> None:
        if room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(plan.left, reverse=True):
        while plan.left.get(length):
            count = plan.left[length]
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                used = min(n, count)
                if used < n:
                    runs[room].append((first + used, n - used))
                if not runs[room]:
                    rooms.pop(at)
                plan.place(length, used, first, plan.capacity - room)
                open_run(room - length, first, used)
            else:
                each = plan.capacity // length
                full, rest = divmod(count, each)
                for k, n in ((each, full), (rest, 1)):
                    if k and n:
                        first = plan.sequences
                        plan.sequences += n
                        for i in range(k):
                            plan.place(length, n, first, i * length)
                        open_run(plan.capacity - k * length, first, n)


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    plan = Plan(histogram, capacity)
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode every document, cut only those longer than `capacity`; a row per piece, with its rank
    among the pieces of its length in its partition."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            doc_ids = iter(batch["doc_id"].to_pylist())
            for ids, bounds in code.encode(batch["text"], end_id):
                raw, bounds = memoryview(ids).cast("B"), bounds.tolist()
                for begin, stop in zip(bounds, bounds[1:]):
                    doc_id = next(doc_ids)
                    for piece, at in enumerate(range(begin, stop, capacity)):
                        length = min(capacity, stop - at)
                        for column, value in zip(rows, (doc_id, piece, at - begin, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), part, seen[length])):
                            column.append(value)
                        seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return docs.select("doc_id", "text").mapInArrow(lean(pieces, "encoders"), PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens, as few as best fit finds.

    Every document is its ids and then `end_id`; a null text is empty and so one token. Documents longer
    than `capacity` are cut into full pieces and a rest, no other is cut. Rows that repeat a doc_id
    are packed each; null doc_ids stay null; an empty table gives no rows; further columns are ignored. Returns
    per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = staged(encode_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = sorted(plan_packing(histogram, capacity).steps)
    keys = np.array([(length << 40) + rank for length, rank, *_ in steps], dtype=np.int64)
    table = np.array(steps, dtype=np.int64).reshape(-1, 5)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            step = table[np.searchsorted(keys, (length << 40) + rank, "right") - 1]
            named = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in named] + [pa.array(step[:, 3] + rank - step[:, 1]), pa.array(step[:, 4])], names=[*named, "sequence_id", "offset"]
            )

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(lean(assign), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
