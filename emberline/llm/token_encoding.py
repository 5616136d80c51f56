"""Whole-text encoding with a word-level tokenizer, shared by packing and binary output."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .memory import MEMOS

#: Bytes that a worker's memo of pieces holds at most, about, before it starts anew; what an entry costs besides its characters.
MEMO_BYTES, ENTRY_BYTES = 100_000_000, 220
#: Bytes of text that are encoded at once (one text at least); pieces that the library encodes at once.
SLICE_BYTES, PIECES = 3_000_000, 400
MARKS = ".,!?"
#: Words of letters that every version of Unicode composes and lowers alike, and one mark at most.
PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}\x{400}-\x{45f}]+[.,!?]?$"
_ENCODERS: dict[str, "WordEncoder"] = {}
MEMOS["encoders"] = _ENCODERS.clear


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts in a row, and how many each has."""
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


class WordEncoder:
    """Ids of whole texts, as arrays of little-endian uint32.

    The tokenizer must drop white space and never join what blanks part (a word-end vocabulary does
    both), so a text's ids are those of its words one after another. The distinct words of a slice of texts are
    cut into the pieces (runs of letters, single digits, runs of marks) of the tokenizer's own pattern;
    pieces recur, so they are remembered. Unknown ones go to the library together, past its
    normalising steps, and its word-end tokens tell them apart again. Words that hold anything
    unusual go to the library one by one, as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        steps = [[step["type"] for step in (described[part] or {}).get(name, [])] for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or described["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path} is no lower-case tokenizer with word ends")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.word_end = np.zeros(self.size, dtype=bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        cut, to_bytes = described["pre_tokenizer"]["pretokenizers"]
        self.pieces_of = regex.compile(cut["pattern"]["Regex"]).findall
        self.special = [token["content"] for token in described["added_tokens"]]
        described |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, to_bytes]}}
        self.plain = Tokenizer.from_str(json.dumps(described))
        self.marks = {mark: vocabulary[f"{mark}</w>"] for mark in MARKS}
        self._start()

    def _start(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _of_pieces(self, wanted: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if self.held > MEMO_BYTES:
            self._start()
        known = self.pieces
        new = [piece for piece in wanted if piece not in known]
        for at in range(0, len(new), PIECES):
            some = new[at : at + PIECES]
            ids = np.array(self.plain.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, begin = ids.tobytes(), 0
                for piece, end in zip(some, (4 * ends).tolist()):
                    known[piece] = raw[begin:end]
                    begin = end
            else:
                for piece in some:
                    known[piece] = self._alone(piece)
        self.held += ENTRY_BYTES * len(new) + 3 * sum(map(len, new))
        return list(map(known.__getitem__, wanted))

    def _usual(self, word: str) -> bool:
        """Whether the pieces of the word in lower case are what the library makes of it."""
        if not word.isascii() and (max(word) >= "԰" or "İ" in word or "Σ" in word or not unicodedata.is_normalized("NFC", word)):
            return False
        return word.isprintable() and not ("<" in word and any(token in word for token in self.special))

    def _of_odd(self, words: list[str]) -> list[bytes]:
        cut = [self.pieces_of(word.lower()) if self._usual(word) else None for word in words]
        distinct = list({piece for pieces in cut if pieces is not None for piece in pieces})
        known = dict(zip(distinct, self._of_pieces(distinct)))
        return [self._alone(word) if pieces is None else b"".join([known[p] for p in pieces]) for word, pieces in zip(words, cut)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each has."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words.filter(pa.array(plain)))
        cores = pc.utf8_rtrim(lower, MARKS).dictionary_encode()
        core, core_ids = cores.indices.to_numpy(zero_copy_only=False), self._of_pieces(cores.dictionary.to_pylist())
        ids, lengths = _joined(core_ids)
        mark = np.full(len(lower), -1, np.int64)
        for sign, number in self.marks.items():
            mark[pc.ends_with(lower, sign).to_numpy(zero_copy_only=False)] = number
        odd_ids, odd_lengths = _joined(self._of_odd(words.filter(pa.array(~plain)).to_pylist()))
        counts = np.zeros(len(words), np.int64)
        counts[plain], counts[~plain] = lengths[core] + (mark >= 0), odd_lengths
        starts = np.cumsum(counts) - counts
        found = np.empty(int(counts.sum()), "<u4")
        found[ragged(starts[plain], lengths[core])] = ids[ragged((np.cumsum(lengths) - lengths)[core], lengths[core])]
        found[(starts[plain] + lengths[core])[mark >= 0]] = mark[mark >= 0]
        found[ragged(starts[~plain], odd_lengths)] = odd_ids
        return found, counts

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slice by slice (ids, bounds): text i of the slice has ids[bounds[i] : bounds[i + 1]], `end_id` last. A null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            lists = pc.ascii_split_whitespace(texts.slice(at, upto - at))
            coded = lists.flatten().dictionary_encode()
            ids, counts = self._of_words(coded.dictionary)
            word = coded.indices.to_numpy(zero_copy_only=False)
            lengths = counts[word]
            bounds = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            made = np.empty(int(bounds[-1]) + upto - at, "<u4")
            ends = bounds[1:] + np.arange(upto - at)
            text = np.ones(len(made), bool)
            text[ends] = False
            made[text] = ids[ragged((np.cumsum(counts) - counts)[word], lengths)]
            made[ends] = end_id
            yield made, np.concatenate([[0], ends + 1])
            at = upto


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file; workers outlive tasks, and so does its memo."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
