"""What Python workers keep between tasks. They outlive tasks and stages, so operators must not pile up memory in them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: How to empty an operator's memo in this worker, by the operator's name.
MEMOS: dict[str, Callable[[], object]] = {}


def lean(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`make` as a function for mapInArrow that finds no memo but its owner's in the worker, and gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in MEMOS.items():
            if name != owner:
                forget()
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run
