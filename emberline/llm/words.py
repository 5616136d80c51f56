"""Words of whole texts as 64-bit hashes, a slice of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are split into words at once, one text at least.
SLICE_BYTES = 3_000_000


def hashed_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice (hashes, bounds): text i of the slice has the words hashes[bounds[i] : bounds[i + 1]].

    Words are what ASCII blanks part; `lower` puts A-Z in lower case first. A null text has none. Distinct words
    of a slice are hashed once.
    """
    texts = texts.cast(pa.string()).fill_null("")
    sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        some = pc.ascii_trim_whitespace(texts.slice(at, upto - at))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(some) if lower else some)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        values = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        word = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        if b"" in distinct:  # an empty text is split into one empty word
            blank = word == distinct.index(b"")
            counts[np.repeat(np.arange(len(counts)), counts)[blank]] -= 1
            word = word[~blank]
        yield values[word], np.concatenate([[0], np.cumsum(counts)])
        at = upto
