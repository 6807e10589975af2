"""Removal of repeated byte strings by a distributed sparse suffix sort.

A byte is removed when a string of LENGTH bytes covers it that also starts
earlier: in a row of smaller id, or earlier in the same row.

Strings meet by anchors: of every LENGTH-byte window the GRAM-byte substring of
least hash, leftmost among equals, is an anchor, so equal windows have equal
anchors at equal places.  An anchor's surroundings are the bytes that any window
with it can have.  Surroundings with the same 128-bit hash, beside the anchor's own,
are taken as equal.  Of occurrences with equal surroundings only the first is of
interest, the others are removed with their surroundings as a whole; that is done
within each chunk before anything is shuffled.  The first ones of an anchor are
then sorted as suffixes, and by their reversed left sides, with a mergesort whose
comparisons find the common extension of two by binary search over prefix
polynomial hashes; every neighbour's common extension is verified on the bytes,
and a collision falls back to a plain sort.  Runs of long enough common extension
tell which windows are the same, and all but the first are removed.

An anchor with more than GROUP different surroundings isn't sorted in one task.
Its windows are halved by how far they begin before the anchor: those of a half
all have some bytes around it, whose hash parts the occurrences, and lie in
narrower surroundings, of which again only the first is of interest.  Halves that
are still too large are halved on, until windows of one beginning are left.

Edge cases: a null text is empty; a null id comes after all others; rows that
repeat an id with other columns are ordered by a 64-bit hash of the row, those
without an id by one of 126 bits; rows that are
the same in all columns are one document and share their result; empty tables
give no rows; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tessella.llm import arrays
from tessella.llm.shared import written

LENGTH = 100
GRAM = 24
GROUP = 1000
SORT_ROWS = 20_000  # rows that a task sorts at once; groups are never split
CHUNK_BYTES = 2 << 20  # text whose anchors a task finds at once

SIDE = LENGTH - GRAM
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_NO_ID = 1 << 62


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = None
    part, size, filled = data.astype(np.uint64) + np.uint64(1), 1, 0
    # Hashes of sizes that double; those that make up GRAM are put together as they come.
    while True:
        if GRAM & size:
            piece = part[filled : filled + n]
            out = piece if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + piece
            filled += size
        if size * 2 > GRAM:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return arrays.mix(out)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors, and their hashes."""
    h = gram_hashes(data)
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = SIDE + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: size - width], low[width - size :])
    whole = np.zeros(len(low) + 1, np.int32)
    first, last = off[:-1], off[1:] - LENGTH
    has = last >= first
    np.add.at(whole, first[has], 1)
    np.add.at(whole, last[has] + 1, -1)
    picked = low[np.cumsum(whole[:-1]) > 0] & np.uint64(0xFFFFFFFF)
    mark = np.zeros(len(h), bool)
    mark[picked.astype(np.int64)] = True
    at = np.flatnonzero(mark)
    return at, h[at]


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by the intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


_KEYS = "doc bigint, tie bigint"
_AROUND = ("h", "c", "c2")  # an anchor and the 128-bit hash of its surroundings
_OCCURRENCE = (*_AROUND, "doc", "tie", "pos")


def _rows(docs: DataFrame) -> DataFrame:
    """``doc, tie, text, rest``: the row's place in the order of all rows, and its other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rest = F.struct(*others)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.xxhash64(text, F.to_json(rest))
    # Rows without an id share no number either: theirs is another hash of 62 bits, above the ids.
    nameless = F.lit(_NO_ID).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(1), text, F.to_json(rest)), 2))
    doc = F.coalesce(F.col("doc_id").cast("long"), nameless)
    return docs.select(doc.alias("doc"), tie.alias("tie"), text.alias("text"), rest.alias("rest"))


def _chunk_anchors(table: pa.Table) -> dict[str, np.ndarray]:
    """The anchors of a chunk in order of hash, surroundings and occurrence."""
    data, off = arrays.text_bytes(table["text"])
    at, h = anchors(data, off)
    row = arrays.owner(at, off)
    a, b = np.maximum(at - SIDE, off[row]), np.minimum(at + LENGTH, off[row + 1])
    around = [arrays.mix(x + (at - a).astype(np.uint64)).view(np.int64) for x in arrays.wide_hashes(data, a, b)]
    found = {
        "h": h.view(np.int64), "c": around[0], "c2": around[1], "doc": arrays.plain(table["doc"]).to_numpy()[row],
        "tie": arrays.plain(table["tie"]).to_numpy()[row], "pos": at - off[row], "s": a - off[row], "e": b - off[row],
    }
    order = np.lexsort([found[k] for k in ("pos", "tie", "doc", "c2", "c", "h")])
    found = {k: v[order] for k, v in found.items()}
    found = {k: v[_new(found)] for k, v in found.items()}
    return found | {"first": ~_equal(found, _AROUND)}


def _equal(rows: dict[str, np.ndarray], names: tuple[str, ...], last: tuple | None = None) -> np.ndarray:
    """Marks rows that have the same values as the one before; ``last`` holds those before the first."""
    same = np.ones(len(rows["h"]), bool)
    for k, name in enumerate(names):
        same[1:] &= rows[name][1:] == rows[name][:-1]
        same[:1] &= last is not None and rows[name][:1] == last[k]
    return same


def _new(rows: dict[str, np.ndarray], last: tuple | None = None) -> np.ndarray:
    """Marks rows that aren't the same occurrence as the one before, as those of equal rows are."""
    return ~_equal(rows, _OCCURRENCE, last)


def _batch(columns: dict[str, np.ndarray], names: str) -> pa.RecordBatch:
    keys = [n.split(" ")[0] for n in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k]) for k in keys], keys)


_ANCHORS = f"h bigint, c bigint, c2 bigint, {_KEYS}, pos bigint, s bigint, e bigint"
_INTERVALS = f"{_KEYS}, s bigint, e bigint"


def _first_anchors(rows: DataFrame) -> DataFrame:
    """Each chunk's first occurrence of every anchor and surroundings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches, most=CHUNK_BYTES):
            found = _chunk_anchors(table)
            yield _batch({k: v[found["first"]] for k, v in found.items()}, _ANCHORS)

    return rows.select("doc", "tie", "text").mapInArrow(run, _ANCHORS)


def _within_chunks(rows: DataFrame) -> DataFrame:
    """Intervals that repeat something of their own chunk with its surroundings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches, most=CHUNK_BYTES):
            found = _chunk_anchors(table)
            again = ~found["first"] & (found["e"] - found["s"] >= LENGTH)
            yield from _merged({k: v[again] for k, v in found.items()})

    return rows.select("doc", "tie", "text").mapInArrow(run, _INTERVALS)


def _merged(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Overlapping intervals of a row as one."""
    if len(found["s"]):
        order = np.lexsort((found["s"], found["tie"], found["doc"]))
        doc, tie, s, e = (found[k][order] for k in ("doc", "tie", "s", "e"))
        row = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
        gap = int(e.max()) + 1
        a, b = union_of(s + row * gap, e + row * gap)
        at = np.searchsorted(row, a // gap)
        yield _batch({"doc": doc[at], "tie": tie[at], "s": a % gap, "e": (b - 1) % gap + 1}, _INTERVALS)


_MARKS = f"h bigint, {_KEYS}, pos bigint, s bigint, e bigint"


def _marks(firsts: DataFrame) -> DataFrame:
    """Repeated surroundings (``h`` null), and first occurrences of anchors with several surroundings.

    Ranges of hash and surroundings deal out a frequent anchor too.  Where a
    range ends amid an anchor, its only one here counts as one of several.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n.split(" ")[0] for n in _ANCHORS.split(", ")]
        last = known = held = None  # the last row; an anchor with several; a first one that is alone so far
        for batch in batches:
            rows = {k: batch[k].to_numpy() for k in names}
            new = _new(rows, last)
            rows = {k: v[new] for k, v in rows.items()}
            if not len(rows["h"]):
                continue
            same = _equal(rows, _AROUND, last)
            known = rows["h"][0] if last is None else known
            last = tuple(rows[k][-1] for k in _OCCURRENCE)
            again = same & (rows["e"] - rows["s"] >= LENGTH)
            yield _marked({k: v[again] for k, v in rows.items()}, False)
            firsts = {k: v[~same] if held is None else np.concatenate([held[k], v[~same]]) for k, v in rows.items()}
            h = firsts["h"]
            if not len(h):
                continue
            several = np.zeros(len(h), bool) if known is None else h == known
            several[1:] |= h[1:] == h[:-1]
            several[:-1] |= h[1:] == h[:-1]
            yield _marked({k: v[several] for k, v in firsts.items()}, True)
            known, held = (h[-1], None) if several[-1] else (None, {k: v[-1:] for k, v in firsts.items()})
        if held is not None:
            yield _marked(held, True)

    dealt = firsts.repartitionByRange("h", "c").sortWithinPartitions(*_OCCURRENCE)
    return dealt.mapInArrow(run, _MARKS)


def _marked(rows: dict[str, np.ndarray], anchor: bool) -> pa.RecordBatch:
    found = _batch(rows, _MARKS)
    return found if anchor else found.set_column(0, pa.field("h", pa.int64()), pa.nulls(found.num_rows, pa.int64()))


def _with_surroundings(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``h, hot, doc, tie, pos, left, right``: bytes before an anchor, nearest first, and from it on."""
    wanted = marks.filter("h is not null")
    sizes = wanted.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = wanted.join(sizes, "h").select("doc", "tie", F.struct("h", (F.col("size") > GROUP).alias("hot"), "pos").alias("a"))
    wanted = wanted.groupBy("doc", "tie").agg(F.collect_list("a").alias("found"))
    schema = f"h bigint, hot boolean, {_KEYS}, pos bigint, left binary, right binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches):
            lists = arrays.plain(table["found"])
            row = np.repeat(np.arange(len(lists)), np.diff(arrays.offsets_of_list(lists)))
            found = lists.flatten()
            h, hot, pos = (found.field(k) for k in range(3))
            data, off = arrays.text_bytes(table["text"])
            at = pos.to_numpy() + off[row]
            start, end = np.maximum(at - SIDE, off[row]), np.minimum(at + LENGTH, off[row + 1])
            for a in range(0, len(at), SORT_ROWS):
                k = slice(a, a + SORT_ROWS)
                before = data[arrays.ragged(at[k] - start[k], start[k])]
                bounds = np.concatenate([[0], np.cumsum(at[k] - start[k])])
                turned = before[_reversed(bounds)]
                columns = [h[k], hot[k], arrays.plain(table["doc"]).take(pa.array(row[k])), arrays.plain(table["tie"]).take(pa.array(row[k])), pos[k]]
                after = data[arrays.ragged(end[k] - at[k], at[k])]
                columns += [_bytes(turned, bounds), _bytes(after, np.concatenate([[0], np.cumsum(end[k] - at[k])]))]
                yield pa.RecordBatch.from_arrays(columns, [n.split(" ")[0] for n in schema.split(", ")])

    return texts.join(wanted, ["doc", "tie"]).mapInArrow(run, schema)


def _reversed(bounds: np.ndarray) -> np.ndarray:
    """Indices that turn every piece round."""
    size = np.diff(bounds)
    return np.repeat(bounds[1:] + bounds[:-1] - 1, size) - np.arange(bounds[-1])


def _bytes(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of symbols 1 to 256, then 0; and their lengths."""
    data, off = arrays.text_bytes(column)
    size = np.diff(off)
    out = np.zeros((len(size), width), np.uint16)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(data)) - np.repeat(off[:-1], size)] = data.astype(np.uint16) + 1
    return out, size


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Polynomial hashes of every prefix of every row."""
    out = np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64)
    for k in range(symbols.shape[1]):
        out[:, k + 1] = out[:, k] * np.uint64(_BASE) + symbols[:, k]
    return out


def common(hashes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows x and y, by binary search over their hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), hashes.shape[1] - 1)
    for _ in range(int(hashes.shape[1]).bit_length()):
        middle = (low + high + 1) // 2
        same = hashes[x, middle] == hashes[y, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(group: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of every group in order, and the common prefix of each with the one before.

    ``group`` ascends.  A bottom-up mergesort of all groups at once: a row's place
    in a merged run is its own place and the number of rows of the sibling run
    before it, found by binary search with ``common`` as comparison.  The first
    row of a group has common prefix -1.
    """
    n, width = symbols.shape
    hashes = prefix_hashes(symbols)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: n and None]
    size = np.diff(np.append(edge, n))
    first, last = np.repeat(edge, size), np.repeat(edge + size, size)
    order, place = np.arange(n), np.arange(n)

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        k = common(hashes, x, y)
        at = np.minimum(k, width - 1)
        return np.where(k == width, ties, symbols[x, at] < symbols[y, at])

    run = 1
    while n and run < size.max():
        own = (place - first) // run
        start = first + own * run
        even = own % 2 == 0
        low = np.where(even, np.minimum(start + run, last), start - run)
        high = np.where(even, np.minimum(start + 2 * run, last), start)
        left = low.copy()
        busy = np.flatnonzero(low < high)
        while len(busy):
            middle = (low[busy] + high[busy]) // 2
            # Equal rows of the even run come first.
            before = less(order[middle], order[busy], ~even[busy])
            low[busy] = np.where(before, middle + 1, low[busy])
            high[busy] = np.where(before, high[busy], middle)
            busy = busy[low[busy] < high[busy]]
        target = np.where(even, start, start - run) + (place - start) + (low - left)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        run *= 2
    match = np.full(n, -1)
    inner = np.flatnonzero(place != first)
    match[inner] = common(hashes, order[inner], order[inner - 1])
    return _checked(group, symbols, order, match, inner)


def _checked(group: np.ndarray, symbols: np.ndarray, order: np.ndarray, match: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order and common prefixes if the bytes bear them out, else those of a plain sort."""
    a, b = symbols[order[inner]], symbols[order[inner - 1]]
    true = np.where((a == b).all(1), symbols.shape[1], (a != b).argmax(1))
    at = np.minimum(true, symbols.shape[1] - 1)
    rows = np.arange(len(inner))
    if not (np.array_equal(true, match[inner]) and ((b[rows, at] < a[rows, at]) | (true == symbols.shape[1])).all()):
        order = np.lexsort([*symbols.T[::-1], group])
        a, b = symbols[order[inner]], symbols[order[inner - 1]]
        true = np.where((a == b).all(1), symbols.shape[1], (a != b).argmax(1))
    match[inner] = true
    return order, match


def repeated_windows(group: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and bytes before and after the anchor's place, of every run of windows that an earlier row has.

    Rows ascend by group and then by occurrence.  ``left`` and ``right`` are symbols
    and lengths of the surroundings.
    """
    n = len(group)
    by_left, same_left = suffix_sort(group, left[0])
    by_right, same_right = suffix_sort(group, right[0])
    rows, reach = [], []
    for before in range(SIDE + 1):
        after = LENGTH - before
        able = np.flatnonzero((left[1] >= before) & (right[1] >= after))
        if len(able) < 2:
            continue
        part = np.empty((2, n), np.int64)
        part[0, by_left] = np.cumsum(same_left < before)
        part[1, by_right] = np.cumsum(same_right < after)
        key = part[0, able] * (n + 1) + part[1, able]
        later = np.ones(len(able), bool)
        later[np.unique(key, return_index=True)[1]] = False
        rows.append(able[later])
        reach.append(np.full(later.sum(), before))
    row, before = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, reach))
    order = np.lexsort((before, row))
    row, before = row[order], before[order]
    new = np.append(True, (row[1:] != row[:-1]) | (before[1:] != before[:-1] + 1))[: len(row)]
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)[: new.sum()]
    return row[new], before[ends], LENGTH - before[new]


def _sorted_intervals(around: DataFrame) -> DataFrame:
    """Intervals found by sorting the surroundings of every anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SORT_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table["h"].to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
                yield from solve(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows = table.num_rows - whole
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            h = table["h"].to_numpy()
            row, before, after = repeated_windows(h, _matrix(table["left"], SIDE), _matrix(table["right"], LENGTH))
            pos = table["pos"].to_numpy()[row]
            yield from _merged({"doc": table["doc"].to_numpy()[row], "tie": table["tie"].to_numpy()[row], "s": pos - before, "e": pos + after})

    dealt = around.repartition("h").sortWithinPartitions("h", "doc", "tie", "pos")
    return dealt.mapInArrow(run, _INTERVALS)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows for either half of the windows, which begin ``lo`` to ``hi`` bytes before the anchor.

    ``key`` is a hash of the bytes that all windows of a half have, ``t1, t2`` one of
    those that any has, to which the surroundings are cut.
    """
    schema = f"key bigint, t1 bigint, t2 bigint, lo bigint, hi bigint, {_KEYS}, pos bigint, left binary, right binary"
    factor = np.uint64(_BASE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, start), (right, mid) = arrays.text_bytes(batch["left"]), arrays.text_bytes(batch["right"])
            before, after = np.diff(start), np.diff(mid)
            h, lo, hi = (batch[c].to_numpy() for c in ("h", "lo", "hi"))
            half = (lo + hi) // 2
            for low, high in ((lo, half), (half + 1, hi)):
                able = np.flatnonzero((low <= high) & (np.minimum(before, high) + np.minimum(after, LENGTH - low) >= LENGTH))
                low, high, a, b = low[able], high[able], start[:-1][able], mid[:-1][able]
                far, on = np.minimum(before[able], high), np.minimum(after[able], LENGTH - low)
                key = arrays.mix(h[able].view(np.uint64) * factor + (low * LENGTH + high).astype(np.uint64))
                key = arrays.mix(key * factor + arrays.hash_spans(left, a, a + low))
                key = arrays.mix(key * factor + arrays.hash_spans(right, b, b + LENGTH - high))
                wide = zip(arrays.wide_hashes(left, a, a + far), arrays.wide_hashes(right, b, b + on), strict=True)
                t1, t2 = (arrays.mix(arrays.mix(key * factor + x) * factor + y).view(np.int64) for x, y in wide)
                columns = [key.view(np.int64), t1, t2, low, high, *(batch[c].to_numpy()[able] for c in ("doc", "tie", "pos"))]
                columns = [pa.array(c) for c in columns]
                for data, first, size in ((left, a, far), (right, b, on)):
                    columns.append(_bytes(data[arrays.ragged(size, first)], np.concatenate([[0], np.cumsum(size)])))
                yield pa.RecordBatch.from_arrays(columns, [n.split(" ")[0] for n in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _narrowed(around: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surroundings to sort, at most GROUP of a kind, and the intervals found on the way to them."""
    columns = ["doc", "tie", "pos", "left", "right"]
    sorts = around.filter("not hot").select("h", *columns)
    found = sorts.select("doc", "tie", F.col("pos").alias("s"), F.col("pos").alias("e")).filter("false")
    now = around.filter("hot").select("h", F.lit(0).cast("long").alias("lo"), F.lit(SIDE).cast("long").alias("hi"), *columns)
    while not now.isEmpty():
        parts = written(_halves(now), "halves")
        own = F.struct("doc", "tie", "pos")
        least = parts.groupBy("t1", "t2").agg(F.min(own).alias("o"))
        met = written(parts.join(least, ["t1", "t2"]).select("key", "lo", "hi", *columns, (own == F.col("o")).alias("first")), "met")
        ends = ((F.col("pos") - F.length("left")).cast("long").alias("s"), (F.col("pos") + F.length("right")).cast("long").alias("e"))
        found = found.unionByName(met.filter("not first").select("doc", "tie", *ends))
        firsts = met.filter("first").drop("first")
        sizes = firsts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        kept = written(firsts.join(sizes, "key").withColumnRenamed("key", "h"), "kept")
        sorts = sorts.unionByName(kept.filter(F.col("size") <= GROUP).select("h", *columns))
        now = kept.filter(F.col("size") > GROUP).select("h", "lo", "hi", *columns)
    return sorts, found


def removed(docs: DataFrame, characters: bool = False) -> DataFrame:
    """``rest, n_bytes, spans, kept`` per row of ``docs``.

    ``rest`` holds the row's columns but the text, ``spans`` the maximal removed
    runs as bytes from and to, ``kept`` the other bytes; with ``characters`` the
    text of the characters that are whole in it.
    """
    rows = _rows(docs)
    marks = written(_marks(_first_anchors(rows)), "marks")
    texts = rows.groupBy("doc", "tie").agg(F.first("text").alias("text"), F.first("rest").alias("rest"), F.count("*").alias("copies"))
    around = written(_with_surroundings(texts, marks), "around")
    found = marks.filter("h is null").select("doc", "tie", "s", "e")
    sorts, narrow = _narrowed(around)
    for more in (_within_chunks(rows), _sorted_intervals(sorts), narrow):
        found = found.unionByName(more)
    found = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    both = texts.join(found, ["doc", "tie"], "left").select("rest", "copies", "text", "found")
    spans_type = ArrayType(StructType([StructField("s", LongType()), StructField("e", LongType())]))
    kept_type = StringType() if characters else BinaryType()
    schema = StructType([both.schema["rest"], both.schema["copies"], StructField("n_bytes", LongType()), StructField("spans", spans_type), StructField("kept", kept_type)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches):
            data, off = arrays.text_bytes(table["text"])
            lists = arrays.plain(table["found"])
            size = np.diff(arrays.offsets_of_list(lists))
            row = np.repeat(np.arange(len(lists)), size)
            pairs = lists.flatten()
            s, e = pairs.field(0).to_numpy() + off[row], pairs.field(1).to_numpy() + off[row]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, s, 1)
            np.add.at(change, e, -1)
            gone = np.cumsum(change[:-1]) > 0
            a, b = arrays.spans(gone, off)
            per = np.bincount(arrays.owner(a, off), minlength=len(lists))
            own = np.repeat(off[:-1], per)
            spans = pa.StructArray.from_arrays([pa.array(a - own), pa.array(b - own)], ["s", "e"])
            if characters:
                char = np.cumsum((data & 0xC0) != 0x80)
                hurt = np.zeros(int(char[-1]) + 1 if len(char) else 1, bool)
                hurt[char[gone]] = True
                gone = hurt[char]
            left = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~gone, out=left[1:])
            kept = _bytes(data[~gone], left[off])
            columns = [
                table["rest"], table["copies"], pa.array(np.diff(off)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), spans),
                kept.cast(pa.string()) if characters else kept,
            ]
            yield from pa.Table.from_arrays(columns, ["rest", "copies", "n_bytes", "spans", "kept"]).to_batches()

    out = both.mapInArrow(run, schema)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of every text; a column ``n_chars`` follows it.

    Of a character that is cut in part nothing is left.
    """
    found = removed(docs, characters=True)
    left = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(left[c].alias(c) if c in left else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
