"""Blocks of whole texts with a dictionary of their own.

Texts of a task are gathered to blocks of about BLOCK_BYTES (a longer text stands alone).
Within a block every word is a number that points into the block's dictionary, so a
shuffle moves each distinct word once per block, and the texts as arrays of numbers.
A block's id is made of the task's partition and its place there: the same rows in the same
order give the same blocks; callers write the blocks once and read that copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from quarry.llm.words import LOWER, SLICE_BYTES, find_words, text_buffer

BLOCK_BYTES = 16 << 20


def gather(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block id, rows): the rows of a task in runs of about `limit` text bytes."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    held, size, n = [], 0, 0

    def flush() -> tuple[int, pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        return part << 33 | n, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        start = 0
        _, off = text_buffer(batch.column(text))
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + max(0, limit - size), side="right")) - 1)
            held.append(batch.slice(start, stop - start))
            size += int(off[stop] - off[start])
            start = stop
            if size >= limit:
                yield flush()
                held, size, n = [], 0, n + 1
        if sum(b.num_rows for b in held) and len(held) >= 4096:
            yield flush()
            held, size, n = [], 0, n + 1
    if held:
        yield flush()


def encode(col: pa.Array, breaks: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words (A-Z in lower case) of a string column as numbers into their dictionary.

    Returns (codes, dictionary, word offsets of the rows, last), where `last` marks words that end a row or,
    with `marks`, are followed by a byte of these before the next word. Works through the rows in slices of
    SLICE_BYTES, so that only words and their numbers are held for all of them."""
    strings, offsets, last, total, start = [], [np.zeros(1, np.int64)], [np.empty(0, bool)], 0, 0
    _, sizes = text_buffer(col)
    while start < len(col):
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE_BYTES, side="right")) - 1)
        buf, off = text_buffer(col.slice(start, stop - start))
        starts, ends, rows = find_words(buf, off, breaks)
        at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=at[1:])
        data = LOWER[buf[~breaks[buf]]] if len(buf) else np.empty(0, np.uint8)
        strings.append(pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]))
        offsets.append(rows[1:] + total)
        cut = np.zeros(len(starts), bool)
        if marks is not None and len(starts):
            places = np.flatnonzero(marks[buf])
            cut[:-1] = np.searchsorted(places, starts[1:]) > np.searchsorted(places, ends[:-1])
        cut[rows[1:][rows[1:] > 0] - 1] = True
        last.append(cut)
        total, start = total + len(starts), stop
    coded = pa.chunked_array(strings, pa.string()).dictionary_encode().combine_chunks() if strings else pa.array([], pa.string()).dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.concatenate(offsets), np.concatenate(last)


def one_list(values: pa.Array) -> pa.Array:
    """One row that holds all `values`."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of `width` bytes, byte plane by byte plane: the upper planes of small numbers are zeros, which compress away."""
    return np.ascontiguousarray(values.astype(f"<i{width}")).view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel()


def pack_pairs(keys: np.ndarray) -> bytes:
    """Sorted pairs x << 32 | y, both below 2**31: the steps of x, and y."""
    return pack(np.diff(keys >> 32, prepend=0)) + pack(keys & 0xFFFFFFFF)


def unpack_pairs(data: bytes) -> np.ndarray:
    half = len(data) // 2
    return np.cumsum(unpack(data[:half]), dtype=np.int64) << 32 | unpack(data[half:]).astype(np.int64)


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their frequency, and the sums of `values` over them."""
    if not len(keys):
        return (keys, np.empty(0, np.int64), *[np.empty(0, np.int64) for _ in values])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.append(first, len(k)))
    return (k[first], n, *[np.add.reduceat(v[order].astype(np.int64), first) for v in values])
