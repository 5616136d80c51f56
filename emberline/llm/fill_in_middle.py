"""Fill-in-middle transformation by an indexable skip list.

A text's units (runs of ASCII letters, every other character by itself) are the nodes of a skip list. A link carries two widths, the units
and the code points it passes, on the lowest lane one unit and its characters, on the express lanes the sums over what they pass.
A cut is a rank among the units: descending from the top lane, each link is taken whose units don't pass the rank, and the code
points of the links taken add up to the exact place of the cut, however long the text.

A node's height follows from its place by a hash, so that a task that runs again cuts alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import lean
from .shared import unused

SENTINELS = ("<P>", "<S>", "<M>")
#: Nodes of a lane to one of the lane above, as bits; the lanes at most.
THINNER, LANES = 2, 16
#: Bytes of text that are cut at once, one text at least.
SLICE_BYTES = 3_000_000


class SkipList:
    """Units in order, reached by rank through lanes of links with a width in units and one in code points."""

    def __init__(self, widths: np.ndarray):
        """`widths` are the code points of each unit."""
        n = len(widths)
        mixed = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        nodes, units, points = np.arange(n), np.ones(n, np.int64), widths.astype(np.int64)
        #: Per lane, lowest first: the links' units, their code points, and the place in the lane below where each ends.
        self.lanes = [(units, points, np.zeros(n, np.int64))]
        for lane in range(1, LANES):
            kept = np.flatnonzero((mixed[nodes] & np.uint64((1 << THINNER * lane) - 1)) == 0)
            if len(kept) < 2:
                break
            # A link ends after the node it is named for; what lies behind the last one is left to the lanes below.
            sums = [np.diff(np.cumsum(width)[kept], prepend=0) for width in (units, points)]
            nodes, units, points = nodes[kept], *sums
            self.lanes.append((units, points, kept + 1))

    def place(self, rank: int) -> int:
        """The code points before the unit of this rank; those of all units if there is none."""
        passed = reached = at = 0
        for units, points, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                reached += int(points[at])
                at += 1
            at = int(below[at - 1]) if at and len(below) else 0
        return reached


def unit_widths(text: str) -> np.ndarray:
    """The code points of each unit of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((codes | 32) - ord("a")) < 26  # unsigned, so what is below wraps far above
    starts = np.flatnonzero(~(letter & np.concatenate([[False], letter[:-1]])))
    return np.diff(starts, append=len(codes))


def draws(key: object, seed: int) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 from the seed and a key; null is an empty one."""
    raw = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(raw[i : i + 4]) for i in range(0, 16, 4))


def transform(text: str, key: object, seed: int, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    widths = unit_widths(text)
    n, (first, second, chosen, order) = len(widths), draws(key, seed)
    if not n or chosen % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    lanes = SkipList(widths)
    low, high = (lanes.place(rank) for rank in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = sentinels
    if order % 100 < spm:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Raises an error if a sentinel could be found where two texts and a sentinel meet."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("sentinels must be non-empty and must not overlap")
    if len({*sentinels}) != 3:
        raise ValueError("three different sentinels are needed")


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS, key: str = "doc_id") -> DataFrame:
    """All columns of `docs` but text, with n (its units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    `rate` of 100 texts are cut at two ranks drawn from the seed and the key, `spm` of 100 of these put the suffix first. Null texts are empty;
    an empty text, and one that holds a sentinel, stays plain. Rows that share a key are cut at ranks drawn alike; a null key
    counts as empty text. Columns of these names are replaced; an empty table gives no rows. A text and its output are in memory whole.
    """
    _checked(sentinels)
    made = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    kept = [c for c in docs.columns if c.lower() not in ("text", *(name for name, _ in made))]
    (drawn,) = unused(kept, "fill_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.string()).fill_null("")
            sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
                rows = batch.slice(at, upto - at)
                found = [transform(t, k, seed, rate, spm, sentinels) for t, k in zip(texts.slice(at, upto - at).to_pylist(), rows[drawn].to_pylist())]
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), *arrays], names=[*kept, *(name for name, _ in made)])
                at = upto

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.select(*kept).schema), *(T.StructField(*m) for m in made)])
    return docs.select(*kept, "text", F.col(key).cast("string").alias(drawn)).mapInArrow(lean(cut), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, from it and its form alone; null for a null output.

    No sentinel stands in a text or where it meets another, so each is found where it was put.
    """
    _checked(sentinels)
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    after = lambda part, mark: F.substr(part, F.lit(len(mark) + 1))
    psm = F.concat(after(F.substring_index(head, s, 1), p), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, after(F.substring_index(head, p, 1), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
