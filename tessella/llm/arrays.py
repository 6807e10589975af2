"""Whole texts as numpy arrays: bytes, words, lines and exact codes.

Everything here works on one bounded chunk of an Arrow stream inside a task.
A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20

# The bytes that separate words, and the characters that count as symbols.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup a stream into tables of about ``most`` text bytes.

    Rows are never cut: one longer text makes a chunk of its own.
    """
    held, size = [], 0
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.diff(offsets_of(batch.column(at)))
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(sizes[start:])
            n = max(1, int(np.searchsorted(ends, max(1, most - size), side="right")))
            part = batch.slice(start, n)
            if held and size + ends[len(ends[:n]) - 1] > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            size += int(ends[len(ends[:n]) - 1])
            start += n
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def plain(array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    return array


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets of every value in the array's data buffer."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if len(array) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)


def offsets_of_list(array: pa.Array) -> np.ndarray:
    """Bounds of every list in the flattened values; a null list is empty."""
    return np.concatenate([[0], np.cumsum(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row, and the offsets of each text in them."""
    array = plain(array)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    off = offsets_of(array)
    buffer = array.buffers()[2] if len(array) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(mark: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; no run crosses a text's end."""
    n = len(mark)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    inner = off[1:-1]
    inner = inner[inner < n]
    first[inner] = mark[inner]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    ends = inner[inner > 0] - 1
    last[ends] = mark[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of each word's text."""
    starts, ends = spans(~SPACE[data], off)
    return starts, ends, owner(starts, off)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and the number of each line's text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([off[1:], breaks])
    doc = np.concatenate([np.arange(len(off) - 1), owner(breaks, off)])
    by_start, by_end = np.lexsort((starts, doc)), np.lexsort((ends, doc))
    return starts[by_start], ends[by_end], doc[by_start]


def owner(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, positions, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings ``data[start:end]``; spans must ascend without overlap."""
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2] = starts, ends
    bounds[-1] = ends[-1] if len(ends) else 0
    kind, size = (pa.binary(), np.int32) if len(data) < 2**31 else (pa.large_binary(), np.int64)
    both = pa.Array.from_buffers(kind, 2 * len(starts), [None, pa.py_buffer(bounds.astype(size)), pa.py_buffer(np.ascontiguousarray(data))])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """An exact number for each value, and the distinct values."""
    found = values.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def renumber(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """One exact number per distinct row of the columns, and how many there are."""
    import pandas as pd

    code, n = columns[0], int(columns[0].max(initial=-1)) + 1
    for column in columns[1:]:
        width = int(column.max(initial=-1)) + 1
        code, found = pd.factorize(code * width + column)
        n = len(found)
    return np.asarray(code, np.int64), n


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices ``start, start+1, ...`` of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or starts.max() < 2**30) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - ends + lengths).astype(kind), lengths)


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one value for each value."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are the same in every task."""
    return _hashed(data, starts, ends, (0x9E3779B97F4A7C15,))[0]


def wide_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The two halves of 128-bit hashes of byte spans; the first are ``hash_spans``."""
    return _hashed(data, starts, ends, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, factors: tuple[int, ...]) -> list[np.ndarray]:
    """One hash of every span per factor; the factors share the reading of the bytes."""
    lengths = ends - starts
    if not len(lengths):
        return [np.zeros(0, np.uint64) for _ in factors]
    factors = [np.uint64(f) for f in factors]
    out = [mix(lengths.astype(np.uint64) + f) for f in factors]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    left = np.arange(len(lengths))
    done = 0
    while len(left):
        word = words[starts[left] + done]
        keep = np.minimum(lengths[left] - done, 8).astype(np.uint64)
        word &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.maximum(keep, 1).astype(np.uint64))
        word[keep == 0] = 0
        for h, f in zip(out, factors, strict=True):
            h[left] = mix(h[left] * f + word)
        done += 8
        left = left[lengths[left] > done]
    return out
