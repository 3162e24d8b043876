"""Shared plumbing: free column names and Arrow batch handling."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from plumbline.functions.frames import free_names  # noqa: F401
from plumbline.scratch import materialize, new_table, release  # noqa: F401

#: Text bytes that one vectorised step handles at once; keeps a Python worker's memory flat.
CHUNK_BYTES = 4 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so very long texts do not pile up in a worker.

    A bound that the session was given stays as it is.
    """
    given = spark.conf.getAll
    for key, value in (("maxBytesPerBatch", str(CHUNK_BYTES)), ("maxRecordsPerBatch", "2000")):
        key = f"spark.sql.execution.arrow.{key}"
        if key not in given:
            spark.conf.set(key, value)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def settled(run: Callable) -> Callable:
    """A map over Arrow batches that returns its free memory to the system when a task ends.

    Python workers outlive their tasks and wait beside an executor's heap.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return mapped


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK_BYTES of text each, at least one row a slice."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // CHUNK_BYTES
    cuts = np.flatnonzero(np.diff(block)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: row offsets (n + 1) and the flat words. Null: none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.concatenate(([0], np.cumsum(counts)))
    before = np.concatenate(([0], np.cumsum(full)))
    return before[raw].astype(np.int64), flat.filter(pa.array(full))


def join_words(offsets: np.ndarray, words: pa.Array) -> pa.Array:
    """Each row's words joined by one space."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each flat item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), so that order and low bits are uniform."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as the narrowest unsigned integers, their width in the first byte."""
    own = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    return bytes([own.itemsize]) + zlib.compress(own.tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)
