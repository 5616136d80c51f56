"""SentencePiece encoding by a table of distinct marked words, and decoding.

The library puts a marker for every blank, and one before the text. Where no piece of the model holds a marker after
another character, no merge reaches from the end of a word to the marker of the next, so a text's ids are those of its marked
words (a run of markers and the characters up to the next marker) one after another, whatever their order of merging. So each distinct
marked word of a slice of texts is segmented once, by the library, into a table (marked word, ids); texts are rows of places in that
table, and their ids are joined back by position. Words recur, so a worker keeps its table between slices, up to a bound.

The table is a worker's own: a corpus-wide one would shuffle a row for every word of every text to save
segmenting a word once in each worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .memory import MEMOS, lean
from .token_encoding import ragged

MARK = "▁"
#: Bytes that a worker's table holds at most, about, before it starts anew; what an entry costs besides its characters and ids.
TABLE_BYTES, ENTRY_BYTES = 100_000_000, 220
#: Bytes of text that are encoded at once, one text at least; ids that are decoded at once, one text's at least.
SLICE_BYTES, SLICE_IDS = 3_000_000, 1_000_000
_ENCODERS: dict[str, "PieceEncoder"] = {}
MEMOS["pieces"] = _ENCODERS.clear


class PieceEncoder:
    """Ids of whole texts through a table of distinct marked words.

    The model must leave texts as they are but for the markers, and have no piece with a marker after another character.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = self.library.id_to_piece(list(range(self.library.vocab_size())))
        kept = " Å\tﬁ  ａ\ńÉ "
        if any(MARK in piece.lstrip(MARK) for piece in pieces) or self.library.normalize(kept) != MARK + kept.replace(" ", MARK):
            raise ValueError(f"{path} has pieces across markers or changes texts")
        self.end_id = self.library.eos_id()
        letter = self.library.encode("a")
        self.lone = np.array(self.library.encode(f"a{MARK}")[len(letter) :], "<u4").tobytes()
        self._start()

    def _start(self) -> None:
        self.table: dict[str, bytes] = {}
        self.held = 0

    def _segmented(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, each with the marker that the library puts before it."""
        if self.held > TABLE_BYTES:
            self._start()
        new = [word for word in words if word not in self.table]
        for word, ids in zip(new, self.library.encode(new, num_threads=1)):
            self.table[word] = raw = np.array(ids, "<u4").tobytes() if word else self.lone
            self.held += ENTRY_BYTES + 2 * len(word) + len(raw)
        return list(map(self.table.__getitem__, words))

    def _marked_words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct marked words without their first marker, a place among them for every marked word, bounds of the texts).

        Between two single blanks stands a word or, in a run of blanks, nothing; a marked word is so many nothings and the word
        after them, or the last of the text.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
        parts = lists.flatten().dictionary_encode()
        part, bounds = parts.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        distinct = parts.dictionary.to_pylist()
        nothing = distinct.index("") if "" in distinct else -1
        ends = part != nothing
        ends[bounds[1:] - 1] = True
        ends[(bounds[1:] - 1)[pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0]] = False  # an empty text has no marker
        at = np.flatnonzero(ends)
        first = np.searchsorted(at, bounds)
        begin = np.concatenate([[0], at[:-1] + 1])[: len(at)]
        begin[first[:-1][first[:-1] < first[1:]]] = bounds[:-1][first[:-1] < first[1:]]
        blanks = at - begin
        if not blanks.any():
            return distinct, part[at], first
        keys, place = np.unique(blanks * len(distinct) + part[at], return_inverse=True)
        return [MARK * (k // len(distinct)) + distinct[k % len(distinct)] for k in keys.tolist()], place, first

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slice by slice (ids, bounds): text i of the slice has ids[bounds[i] : bounds[i + 1]], `end_id` last unless that is None. A null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            distinct, place, first = self._marked_words(texts.slice(at, upto - at))
            segmented = self._segmented(distinct)
            ids = np.frombuffer(b"".join(segmented), "<u4")
            counts = np.fromiter(map(len, segmented), np.int64, len(segmented)) // 4
            bounds = np.concatenate([[0], np.cumsum(counts[place])])[first]
            found = ids[ragged((np.cumsum(counts) - counts)[place], counts[place])]
            if end_id is not None:
                found = np.insert(found, bounds[1:], np.uint32(end_id))
                bounds = bounds + np.arange(len(bounds))
            yield found, bounds
            at = upto


def piece_encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a model file; workers outlive tasks, and so does its table."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).add(name, kind)


def encode_pieces(docs: DataFrame, model: str, end: bool = True, column: str = "ids") -> DataFrame:
    """All columns of `docs` but text, with the text's ids as an array, or by the name in `column`.

    The ids are the library's for the whole text, without a begin id or sampling, and with the model's end id if `end`. A null
    or empty text has the end id alone, or none; repeated rows are encoded each; a column of that name is replaced; an empty
    table gives no rows. A text's whole ids are in memory at once, a word of any length is segmented whole.
    """
    kept = [c for c in docs.columns if c.lower() not in ("text", column.lower())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = piece_encoder(model)
        for batch in batches:
            at = 0
            for ids, bounds in code.encode(batch["text"], code.end_id if end else None):
                rows = batch.slice(at, len(bounds) - 1)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), lists], names=[*kept, column])
                at += len(bounds) - 1

    return docs.select(*kept, "text").mapInArrow(lean(encode, "pieces"), _with(docs.select(*kept), column, T.ArrayType(T.IntegerType())))


def decode_pieces(encoded: DataFrame, model: str, column: str = "ids", text: str = "text") -> DataFrame:
    """All columns of `encoded`, with the text that the library's decode makes of the ids, or by the name in `text`.

    Null ids give a null text, no ids an empty one; begin and end ids leave nothing behind. An id outside the model is an error. A column of that name is replaced.
    """
    kept = [c for c in encoded.columns if c.lower() != text.lower()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = piece_encoder(model).library
        for batch in batches:
            sizes, at = np.cumsum(pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(batch):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_IDS, "right")))
                rows = batch.slice(at, upto - at)
                texts = [None if ids is None else library.decode(ids) for ids in rows[column].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, text])
                at = upto

    return encoded.mapInArrow(lean(decode, "pieces"), _with(encoded.select(*kept), text, T.StringType()))
