"""Hierarchical packing of documents into sequences of several context sizes.

A document's whole windows of the longest size stand alone.  What is left of it
goes to the smallest tier that holds it.  Each tier, from the longest down, opens
a window per document and fills the window's gap with the longest shorter pieces
that fit; where none fits, one piece is cut so that the window is exactly full.
The last window of a chunk is laid out as sequences of powers of two.  So every
sequence is a power of two long and nothing is padded.

Each task packs its own rows in bounded chunks: nothing is shuffled, and no key
or source can overload a task.  Sequence numbers hold the partition, so a
recomputed task gives the same rows.

Edge cases: a null or empty text is a document of the end id alone; repeated
rows and null ids are documents of their own (``document`` tells them apart);
other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessella.llm import arrays, simple8b, tokens

LONGEST = 2048
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 32_768
PACK_BYTES = 16 << 20

Piece = tuple[int, int, int]  # document, start, length


class _Rest:
    """What is left of the documents, by length."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            if not self.by_length[length]:
                insort(self.lengths, length)
            self.by_length[length].append((doc, start))

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` ids."""
        k = bisect_right(self.lengths, most)
        return self._pop(k - 1) if k else None

    def shortest(self) -> Piece | None:
        return self._pop(0) if self.lengths else None

    def _pop(self, k: int) -> Piece:
        length = self.lengths[k]
        doc, start = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.lengths[k]
        return doc, start, length


def pack_lengths(lengths: list[int], longest: int = LONGEST, tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that cover every document once."""
    out, rest = [], _Rest()
    for doc, n in enumerate(lengths):
        out += [[(doc, k * longest, longest)] for k in range(n // longest)]
        rest.add(doc, n - n % longest, n % longest)
    for size, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while rest.lengths and rest.lengths[-1] > below:
            first = rest.take(size)
            window, gap = [first], size - first[2]
            while gap:
                piece = rest.take(gap)
                if piece is None:
                    piece = rest.shortest()
                    if piece is None:
                        break
                    doc, start, length = piece
                    rest.add(doc, start + gap, length - gap)
                    piece = doc, start, gap
                window.append(piece)
                gap -= piece[2]
            out += [window] if not gap else powers(window)
    return out


def powers(window: list[Piece]) -> list[list[Piece]]:
    """A short window as sequences whose lengths are its powers of two."""
    out, left = [], sum(p[2] for p in window)
    todo = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        sequence = []
        while size:
            doc, start, length = todo.pop()
            if length > size:
                todo.append((doc, start + size, length - size))
                length = size
            sequence.append((doc, start, length))
            size -= length
        out.append(sequence)
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for every sequence, longest first to the step with the fewest ids."""
    steps = [(0, k) for k in range(max(1, -(-sum(sizes) // step_tokens)))]
    found = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, step = steps[0]
        heapq.heapreplace(steps, (held + sizes[at], step))
        found[at] = step
    return found


def pack(docs: DataFrame, vocabulary: str, end: int = 1, kind: Callable = tokens.word_level) -> DataFrame:
    """One row per piece: where it comes from, where it goes, and its ids.

    ``ids`` are little-endian 32-bit integers.  ``step_group`` numbers steps of
    about STEP_TOKENS ids that mix the tiers evenly.
    """
    names = ["doc_id", "document", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, encoder = TaskContext.get().partitionId() << 36, tokens.of(kind, vocabulary)
        documents = sequences = steps = 0
        for table in arrays.chunks(batches, most=PACK_BYTES):
            ids, bounds = simple8b.with_end(*encoder.ids(*arrays.text_bytes(table["text"])), end)
            packed = pack_lengths(np.diff(bounds).tolist())
            sizes = [sum(p[2] for p in s) for s in packed]
            group = step_groups(sizes)
            flat = np.array([(*p, k) for k, s in enumerate(packed) for p in s], np.int64).reshape(-1, 4)
            doc, start, length, sequence = flat.T
            filled = np.cumsum(length) - length
            offset = filled - np.repeat(filled[np.searchsorted(sequence, np.arange(len(packed)))], np.bincount(sequence, minlength=len(packed)))
            off = np.concatenate([[0], np.cumsum(length)])
            data = ids[arrays.ragged(length, bounds[doc] + start)].astype("<u4")
            columns = [
                arrays.plain(table["doc_id"]).take(pa.array(doc)),
                *map(pa.array, (base + documents + doc, start, length, np.diff(bounds)[doc], base + sequences + sequence, offset, np.array(sizes, np.int64)[sequence], base + steps + np.array(group, np.int64)[sequence])),
                pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(off * 4), pa.py_buffer(data)]).cast(pa.binary()),
            ]
            yield from pa.Table.from_arrays(columns, [*names, "ids"]).to_batches(max_chunksize=20_000)
            documents, sequences, steps = documents + table.num_rows, sequences + len(packed), steps + max(group, default=-1) + 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", ids binary")
