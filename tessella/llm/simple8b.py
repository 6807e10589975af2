"""Token ids in files of Simple-8b words.

Every 64-bit word has a 4-bit selector and 60 bits that hold as many ids as fit
at one width.  Ids are coded in blocks of BLOCK, each starting on a word of its
own whose place is recorded, so any block is decoded alone and all ids of a
block at once.  An id of more than 60 bits is an escape: the word holds its
place in a list of whole 64-bit values.

``write`` puts documents in ascending ``doc_id`` order into segments, one row
each of a Parquet folder: ``part`` and ``segment`` give the order, ``first_id``
the ids before it in its part, ``payload`` the coded documents.  ``read`` gives
the documents back with their place in the whole sequence of ids.

Edge cases: a null or empty text is a document of the end id alone; a null
``doc_id`` sorts first; repeated ids are documents of their own, ordered by
text; an empty table makes an empty folder that reads as no documents; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from tessella.llm import arrays, tokens

BLOCK = 1024
BEGINNING = 64  # characters of a text that ranges of rows tell apart
ESCAPE = 0
# Ids per word and bits per id of selectors 1 to 15.
LAYOUT = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([1] + [n for n, _ in LAYOUT])
WIDTH = np.array([60] + [b for _, b in LAYOUT])
HEAD = struct.Struct("<4sIIIII")  # magic, documents, ids, words, blocks, escapes
MAGIC = b"TS8B"


def _choices(ids: np.ndarray) -> np.ndarray:
    """The selector of a word that starts at each id, one row per block; places behind the ids count as zeros."""
    blocks = -(-len(ids) // BLOCK)
    behind = max(n for n, _ in LAYOUT)
    # Bits of each id as one byte, so that the widest of a run is taken over small numbers.
    bits = np.zeros(blocks * BLOCK, np.uint8)
    bits[: len(ids)] = np.searchsorted(np.uint64(1) << np.arange(61, dtype=np.uint64), ids, side="right")
    bits = np.concatenate([bits.reshape(blocks, BLOCK), np.zeros((blocks, behind), np.uint8)], 1)
    widest, run, selector = bits, 1, np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s, (count, width) in reversed(list(enumerate(LAYOUT, 1))):
        while 2 * run <= count:
            widest = np.maximum(widest[:, : widest.shape[1] - run], widest[:, run:])
            run *= 2
        # Two runs that overlap cover the word's ids.
        late = widest[:, count - run : count - run + BLOCK]
        np.copyto(selector, s, where=np.maximum(widest[:, :BLOCK], late) <= width)
    return selector


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, the first word of every block, and the escaped values.

    All blocks move on by a word at once, so there are as many steps as words in the longest block.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    choice = _choices(ids)
    size = np.minimum(BLOCK, n - np.arange(len(choice)) * BLOCK)
    head = np.zeros(choice.shape, bool)
    block, at = np.arange(len(choice)), np.zeros(len(choice), np.int64)
    while len(block):
        head[block, at] = True
        at = at + COUNT[choice[block, at]]
        more = at < size[block]
        block, at = block[more], at[more]
    heads = np.flatnonzero(head)
    chosen = choice.ravel()[heads]
    length = np.minimum(COUNT[chosen], size[heads // BLOCK] - heads % BLOCK)
    out = chosen.astype(np.uint64) << np.uint64(60)
    escaped = chosen == ESCAPE
    values = ids[heads[escaped]]
    out[escaped] |= np.arange(len(values), dtype=np.uint64)
    left = np.flatnonzero(~escaped & (WIDTH[chosen] > 0))
    for k in range(60):
        left = left[length[left] > k]
        if not len(left):
            break
        out[left] |= ids[heads[left] + k] << (WIDTH[chosen[left]] * k).astype(np.uint64)
    firsts = np.searchsorted(heads, np.arange(0, n, BLOCK))
    return out, firsts.astype(np.uint32), values


def unpack_words(words: np.ndarray, firsts: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` ids of the words; ``firsts`` counts from the first given word."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    full = COUNT[selector]
    # Only the last word of a block may hold fewer ids than its selector says.
    size = np.full(len(firsts), BLOCK, np.int64)
    size[-1] = n - BLOCK * (len(firsts) - 1)
    lasts = np.append(firsts[1:], len(words)).astype(np.int64) - 1
    full[lasts] = 0
    full[lasts] = size - np.add.reduceat(full, firsts.astype(np.int64))
    word = np.repeat(np.arange(len(words)), full)
    place = np.arange(n) - np.repeat(np.cumsum(full) - full, full)
    width = WIDTH[selector]
    keep = np.where(width > 0, (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1), np.uint64(0)).astype(np.uint64)
    ids = (words[word] >> (place * width[word]).astype(np.uint64)) & keep[word]
    escaped = np.flatnonzero(selector[word] == ESCAPE)
    ids[escaped] = escapes[ids[escaped].astype(np.int64)]
    return ids


def encode_segment(doc_ids: list, bounds: np.ndarray, ids: np.ndarray) -> bytes:
    words, firsts, escapes = pack_words(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(firsts), len(escapes))
    parts = (names, np.diff(bounds).astype(np.uint32), null, firsts, words, escapes)
    return head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def decode_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, bounds of each document, and all ids of a segment."""
    magic, docs, n, words, blocks, escapes = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of coded ids")
    at = HEAD.size

    def take(kind, count):
        nonlocal at
        found = np.frombuffer(payload, kind, count, at)
        at += found.nbytes
        return found

    names, lengths, null = take(np.int64, docs), take(np.uint32, docs), take(np.uint8, docs)
    firsts, coded, rest = take(np.uint32, blocks), take(np.uint64, words), take(np.uint64, escapes)
    ids = unpack_words(coded, firsts, n, rest)
    doc_ids = [None if x else d for d, x in zip(names.tolist(), null, strict=True)]
    return doc_ids, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), ids


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each document, and the new bounds."""
    out = np.insert(ids, bounds[1:], end)
    return out, bounds + np.arange(len(bounds))


SEGMENTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("part", "segment", "first_id", "n_ids", "n_docs")] + [T.StructField("payload", T.BinaryType())]
)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0, kind: Callable = tokens.byte_level) -> None:
    """Write the ids of all documents below ``path``, a folder all executors share."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encoder = TaskContext.get().partitionId(), 0, tokens.of(kind, vocabulary)
        for segment, table in enumerate(arrays.chunks(batches)):
            ids, bounds = with_end(*encoder.ids(*arrays.text_bytes(table["text"])), end)
            payload = encode_segment(table["doc_id"].to_pylist(), bounds, ids)
            row = [part, segment, before, len(ids), table.num_rows, payload]
            yield pa.RecordBatch.from_pylist([dict(zip(SEGMENTS.names, row, strict=True))], pa.schema([(n, pa.int64()) for n in SEGMENTS.names[:-1]] + [("payload", pa.binary())]))
            before += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The beginnings of texts order the rows of one id as their texts do, and spread them over ranges.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, BEGINNING)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(code, SEGMENTS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ids as little-endian 32-bit integers.

    The only table that is broadcast has one row per written part.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = segments.join(F.broadcast(parts), "part").select((F.col("before") + F.col("first_id")).alias("start"), "payload")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch["start"].to_pylist(), batch["payload"], strict=True):
                doc_ids, bounds, ids = decode_segment(payload.as_py())
                off = (bounds * 4).astype(np.int32)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)),
                        pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(off), data]),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
