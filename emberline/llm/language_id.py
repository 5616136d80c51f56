"""Language identification with hyperdimensional profiles.

Every letter gets a random vector of +1 and -1. A trigram's vector binds its letters' vectors, each
rotated by its place; a text's vector bundles (adds) the vectors of all its trigrams. A language's
prototype bundles the unit vectors of its training texts, and a text takes the language whose prototype
has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import MEMOS, lean

DIMENSIONS, ORDER, SEED = 1024, 3, 20_240_229
#: Trigram vectors that a worker holds at most; vectors that are added up at once; characters that are bundled at once.
MEMO, ROWS, CHUNK = 30_000, 2048, 1 << 19
#: Labelled rows that prototypes are learned from at most (in expectation).
MAX_TRAINING_ROWS = 30_000
#: A unit vector's components are summed as integers of this scale, so the sum has no order.
SCALE = 10_000
BLANK = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Bundler:
    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self._start()

    def _start(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dimensions), dtype=np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            draw = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = 2 * draw - 1
        return self.letters[code]

    def _row(self, gram: int) -> int:
        if len(self.rows) == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        at = self.rows[gram] = len(self.rows)
        bound = np.ones(self.dimensions, dtype=np.int8)
        for place in range(ORDER):
            bound *= np.roll(self._letter(gram >> 21 * place & 0x1FFFFF), place)
        self.vectors[at] = bound
        return at

    def _add(self, codes: np.ndarray, total: np.ndarray) -> None:
        grams = (codes[:-2].astype(np.int64) << 42) | (codes[1:-1].astype(np.int64) << 21) | codes[2:]
        unique, counts = np.unique(grams, return_counts=True)
        for at in range(0, len(unique), ROWS):
            if len(self.rows) > MEMO:
                self._start()
            some = unique[at : at + ROWS].tolist()
            rows = [self.rows[g] if g in self.rows else self._row(g) for g in some]
            total += counts[at : at + ROWS].astype(np.float32) @ self.vectors[rows].astype(np.float32)

    def text(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None without letters."""
        total, tail, any_letter = np.zeros(self.dimensions, np.float32), np.array([BLANK], np.uint32), False
        text = text or ""
        for at in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le"), np.uint32)
            letter = _letters()[codes]
            any_letter |= bool(letter.any())
            codes = np.concatenate([tail, np.where(letter, codes, BLANK)])
            blank = codes == BLANK
            codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
            if len(codes) > 2:
                self._add(codes, total)
            tail = codes[-2:]
        if not any_letter:
            return None
        if tail[-1] != BLANK and len(tail) == 2:
            self._add(np.append(tail, np.uint32(BLANK)), total)
        return total


@cache
def _bundler(dimensions: int, seed: int) -> Bundler:
    return Bundler(dimensions, seed)


MEMOS["language"] = _bundler.cache_clear


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def learn_prototypes(docs: DataFrame, label: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED, max_rows: int = MAX_TRAINING_ROWS) -> dict[str, np.ndarray]:
    """Unit prototypes of the label's values, from a sample of about `max_rows` labelled rows.

    The sample is drawn by a hash of doc_id and text, so it is the same on every run. One vector per label
    value reaches the driver. Null labels and texts without letters teach nothing.
    """
    labelled = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), "text", "doc_id")
    rows = labelled.count()
    if rows > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(max_rows / rows * (1 << 30)))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = _bundler(dimensions, seed), {}
        for batch in batches:
            for value, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
                vector = own.text(text)
                if vector is not None and (norm := float(np.linalg.norm(vector))):
                    sums[value] = sums.get(value, 0) + np.rint(vector / norm * SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["label", "sums"])

    sums = labelled.mapInArrow(lean(bundle, "language"), "label string, sums array<long>").select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    prototypes: dict[str, np.ndarray] = {}
    for r in sums.collect():  # a vector per label value
        prototypes.setdefault(r["label"], np.zeros(dimensions))[r["pos"]] = r["s"]
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(prototypes.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED, columns: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs`, with lang_pred and score (a cosine, negative ones as 0), or by the names in `columns`.

    Only the text is looked at, the whole of it. Null texts, texts without letters, and every text
    when nothing was learned get `und` and 0. Ties go to the first value in order. Repeated rows are judged each;
    columns of these names are replaced. An empty table gives no rows.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], dtype=np.float64).reshape(len(names), dimensions)
    kept = [c for c in docs.columns if c not in columns]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _bundler(dimensions, seed)
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"]:
                vector = own.text(text.as_py()) if names else None
                norm = 0.0 if vector is None else float(np.linalg.norm(vector))
                cosines = matrix @ vector / norm if norm else None
                best = -1 if cosines is None else int(np.argmax(cosines))
                langs.append("und" if best < 0 else names[best])
                scores.append(0.0 if best < 0 else min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *columns])

    schema = docs.select(*kept).withColumns({columns[0]: F.lit(""), columns[1]: F.lit(0.0).cast("double")}).schema
    for field in schema:
        field.nullable = True
    return docs.select(*kept).mapInArrow(lean(judge, "language"), schema)
