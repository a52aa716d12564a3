"""Vectorised word splitting and word hashing over Arrow string columns.

Works straight on the UTF-8 buffer of a batch: one table lookup per byte says
whether it belongs to a word, and a prefix sum of ``value[byte] * B**i`` gives
every word's hash without a Python loop. Hashes are 64-bit and the same in
every process and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20            # bytes hashed at once; only a longer single word exceeds it
SLICE_BYTES = 2 << 20        # text bytes handled at once; only a longer single text exceeds it
BASE = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def lower_ascii_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: words are runs of anything but [\x20\x09-\x0D]
WHITE_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: words are runs of [0-9a-z] (after lower-casing A-Z) and of anything non-ASCII
NOT_ALNUM = np.array([b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
LOWER = lower_ascii_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h ^= h >> np.uint64(33)
    h *= MIX[1]
    return h ^ (h >> np.uint64(33))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[LOWER]   # A-Z hash as a-z
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
                      for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls hold none) and the n + 1 offsets."""
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.string()), np.int32
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` text bytes (a longer text stands alone)."""
    _, off = text_buffer(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def find_words(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the texts."""
    inside = ~breaks[buf]
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True                                    # a text's end also ends a word
    cut = first[:-1]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (cut | ~before))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + SEGMENT, side="right")))
        n = int(ends[j - 1] - at)
        power, inverse = _powers(max(n, SEGMENT))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[buf[at:at + n]] * power[:n], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def hash_windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` consecutive words (texts' borders ignored)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(BASE)
        h += words[k:k + n]
    return mix(h + np.uint64(width))


def one_hash(words: np.ndarray) -> np.uint64:
    """The hash of one whole word sequence; equals its window hash of that width."""
    return hash_windows(words, len(words))[0]
