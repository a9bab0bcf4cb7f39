"""What the operators share: tables kept in the shared folder, parts of Arrow batches, hashes of ids."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from duelkit.functions.values import let
from duelkit.sources.tables import kept, table
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["crc_of_id", "held", "kept", "let", "parts", "release", "table"]

#: Rows and text bytes that a Python worker handles at once; one longer text is handled alone.
PART_ROWS, PART_BYTES = 1000, 4_000_000


#: What this Python worker holds from task to task: one model or tokenizer at most.
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """One for each worker, whatever the number of its tasks. Workers outlive a stage, so what an earlier one held goes."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go what this worker holds of an earlier stage, and gives the memory back to the system."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)


def parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of bounded size, whatever the session's own bounds of a batch are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start >= PART_ROWS or held + size > PART_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of an id's decimal text (null id: of the empty text)."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary"))
