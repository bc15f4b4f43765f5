"""Words, lines and their 64-bit hashes, for whole Arrow batches of UTF-8 texts in numpy.

Work is cut into runs of whole texts of about WINDOW bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; spans longer than LONG are hashed one by one.
WINDOW, LONG = 1 << 19, 1 << 16
#: The bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(salt)) | np.uint64(1)


@cache
def _bytes_table(separators: tuple[int, ...]) -> np.ndarray:
    table = seeds(256, 77)
    table[list(separators)] = 0
    return table


@cache
def _powers() -> np.ndarray:
    out = np.full(LONG + 1, np.uint64(0x9FB21C651E98DF25))
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about window bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + window, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; texts do not run together."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = IS_WORD[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word
    ends[:-1] &= ~IS_WORD[buf[1:]] | first[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def line_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the newline-separated lines, and the text of each; an empty text is one empty line."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    ends = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((starts, text))
    text_of_end = np.concatenate([text[len(offsets) - 1 :], np.arange(len(offsets) - 1)])
    return starts[order], ends[np.lexsort((ends, text_of_end))], text[order]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: tuple[int, ...] = SPACES) -> np.ndarray:
    """64-bit hashes of ascending disjoint spans, between which only separators lie and in which none does."""
    out = np.zeros(len(starts), np.uint64)
    table, powers = _bytes_table(separators), _powers()
    sizes = ends - starts
    a = 0
    while a < len(starts):
        b = min(len(starts), max(a + 1, int(np.searchsorted(ends, starts[a] + WINDOW, "right"))))
        if b == a + 1 and sizes[a] > LONG:
            out[a] = int.from_bytes(hashlib.blake2b(buf[starts[a] : ends[a]].tobytes(), digest_size=8).digest(), "little")
            a = b
            continue
        long = a + np.flatnonzero(sizes[a:b] > LONG)
        if len(long):
            b = max(a + 1, int(long[0])) if long[0] > a else a + 1
            if long[0] == a:
                out[a] = int.from_bytes(hashlib.blake2b(buf[starts[a] : ends[a]].tobytes(), digest_size=8).digest(), "little")
                a = b
                continue
        base, size = starts[a], sizes[a:b]
        where = np.cumsum(size) - size
        total = int(size.sum())
        if total:
            within = np.arange(total, dtype=np.int64) - np.repeat(where, size)
            seg = buf[base : ends[b - 1]]
            if len(seg) != total:
                seg = seg[table[seg] != 0]
            values = table[seg] * powers[within]
            full = size > 0
            sums = np.zeros(b - a, np.uint64)
            sums[full] = np.add.reduceat(values, where[full])
            out[a:b] = mix(sums + size.astype(np.uint64) * np.uint64(_GOLDEN))
        a = b
    return out


def windows(words: np.ndarray, text: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the index of the first word of each."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for i, c in enumerate(seeds(k, salt)):
        total += words[at + i] * c
    return mix(total), at


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
