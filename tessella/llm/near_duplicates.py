"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles; two are linked when their sets'
Jaccard similarity reaches a bound.  Equal sets are one class first.  A tree
branches classes by minwise values: a node picks one or two positions of the
signature by its own hash, and its members part by their values there, so that
similar sets stay together and others part.  A node's members are compared by
bit sketches, which join them to families; independent trees repeat this until
the chance to miss a pair at the bound is below MISS.

A large node is not compared exhaustively: its members are compared with a few
of its own members, which joins groups of many copies at once.  Pairs within a
family need no further comparison; so when few members are outside a node's
largest family, these are compared with all of the node, and any other node
branches on, in several independent subtrees, as a pair is the more easily parted
the deeper a tree gets.  The trees are as many as the greatest depth needs.

Then all full sets of a family are compared with each other.  A family of several
blocks first meets in each block and with a few members that are in all blocks;
then the rows outside its largest component meet the whole family, block by block.
A task that compares rows says which are joined by at most one row for each of
them, so nothing is capped, and no group emits all its pairs.

Edge cases: without words a text's set is empty and linked with nothing; a text
of fewer words than a shingle is one shingle; equal texts are one class however
many; a null id has component null unless a document with an id is in its
component, and is kept if null is its component; rows that repeat an id are
versions of one document, linked by any of their texts; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm import arrays
from tessella.llm.components import components
from tessella.llm.shared import written

POSITIONS = 128  # minwise values in a signature; two bits of each make the sketch
SMALL = 2048  # a node with so many classes outside its largest component is compared exhaustively
NODE_ROWS = 1 << 15  # rows of a node's largest component that a task compares others with
TASK_ROWS = 1 << 14  # rows that a task compares at once; groups are never split
PAIRS = 1 << 17  # pairs of sketches that a task compares at once
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19  # rows of a family that meet at once, and their shingles
FEW = 8  # shingles of so many rows of a large group are counted pair by pair
CELLS = 1 << 20  # cells of the matrix that counts the others
CHUNK_BYTES = 1 << 20  # text whose shingles a task finds at once
PIVOTS = 4  # members that all others of a larger node are compared with
TWICE = 0.25  # share of nodes that branch by two positions
MISS = 1e-4
STEP = 3  # levels that a large node branches at once
DEEPEST = 24
SPREAD = 4.5  # standard deviations by which a sketch may fall short

SKETCH = ["s0", "s1", "s2", "s3"]

_NAMELESS = 1 << 62  # classes without any id are numbered from here

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, by text, and the bounds of each text's."""
    n = len(off) - 1
    low = arrays.lowered(data)
    starts, ends, doc = arrays.words(low, off)
    word = arrays.hash_spans(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    shingle = np.zeros(len(word), np.uint64)
    for k in range(size):
        nxt = np.minimum(np.arange(len(word)) + k, len(word) - 1)
        inside = doc[nxt] == doc if len(word) else np.zeros(0, bool)
        inside &= np.arange(len(word)) + k < len(word)
        shingle = arrays.mix(shingle * _GOLDEN + np.where(inside, word[nxt], np.uint64(k + 1)))
    place = np.arange(len(word)) - first[doc]
    whole = (place + size <= count[doc]) | (place == 0)
    doc, shingle = doc[whole], shingle[whole]
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]).astype(np.int64)


def _constants(count: int, seed: int) -> np.ndarray:
    return arrays.mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values per text, hashed to 16 bits; texts must not be empty."""
    starts = bounds[:-1]
    out = np.empty((len(starts), POSITIONS), np.uint16)
    for k, (a, b) in enumerate(zip(_constants(POSITIONS, 11), _constants(POSITIONS, 977_777), strict=True)):
        if len(starts):
            least = np.minimum.reduceat(((hashes ^ b) * a >> np.uint64(32)).astype(np.uint32), starts)
            out[:, k] = arrays.mix(least) >> np.uint64(48)
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four 64-bit words per text: two hashed bits of every minwise value."""
    bits = (arrays.mix(signature.astype(np.uint64) * _GOLDEN + np.arange(POSITIONS, dtype=np.uint64)) >> np.uint64(62)).astype(np.uint64)
    words = np.zeros((len(signature), 4), np.uint64)
    for k in range(POSITIONS):
        words[:, k // 32] |= bits[:, k] << np.uint64(2 * (k % 32))
    return words.view(np.int64)


def branch(node: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes for members with these signatures: the member's row, and the child."""
    rows, children = [], []
    for k in range(2):
        pick = arrays.mix(node.view(np.uint64) + np.uint64(k + 1) * _GOLDEN)
        own = np.arange(len(node))
        if k:
            own = own[(arrays.mix(node.view(np.uint64) ^ _GOLDEN) >> np.uint64(40)).astype(np.float64) < TWICE * 2**24]
        at = (pick[own] % np.uint64(POSITIONS)).astype(np.int64)
        child = arrays.mix(pick[own] * _GOLDEN + signature[own, at].astype(np.uint64))
        rows.append(own)
        children.append(child.view(np.int64))
    return np.concatenate(rows), np.concatenate(children)


def subtrees(node: np.ndarray, signature: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes STEP levels down in every independent subtree: the member's row, and the node."""
    row = np.tile(np.arange(len(node)), copies)
    seed = np.repeat(np.arange(copies, dtype=np.uint64), len(node))
    node = arrays.mix(np.tile(node.view(np.uint64), copies) + (seed + np.uint64(5)) * _GOLDEN).view(np.int64)
    for _ in range(STEP):
        moved, node = branch(node, signature[row])
        row = row[moved]
    return row, node


def copies_of(similarity: float) -> int:
    """Subtrees of a large node: a pair at the bound is expected in twice as many nodes after STEP levels as before."""
    return math.ceil(2 / (similarity * (1 + TWICE)) ** STEP - 1e-6)


def missed(similarity: float, depth: int, lost: float = 0.0) -> float:
    """The chance that a pair at the bound shares no node of one tree at a depth; of a shared one ``lost`` is missed."""
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = (1 - TWICE) * one + TWICE * one * one
    return lost


def missed_by(trees: int, similarity: float, depth: int) -> float:
    """The chance that all trees miss a pair at the bound, if its nodes are large down to DEEPEST.

    Over all numbers of positions that its signatures may have in common.
    """
    equal = np.arange(POSITIONS + 1)
    often = np.array([math.comb(POSITIONS, k) for k in equal], float) * similarity**equal * (1 - similarity) ** (POSITIONS - equal)
    lost = np.zeros(POSITIONS + 1)
    for _ in range(depth, DEEPEST + 1 - STEP, STEP):
        lost = missed(equal / POSITIONS, STEP, lost) ** copies_of(similarity)
    return float((often * missed(equal / POSITIONS, depth, lost) ** trees).sum())


def trees_for(similarity: float, depth: int) -> int:
    """The fewest trees whose chance to miss a pair at the bound is at most MISS."""
    low, high = 0, 1
    while missed_by(high, similarity, depth) > MISS:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed_by(middle, similarity, depth) > MISS else (low, middle)
    return high


def _described(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, k1, k2, s0..s3, signature``: set size, a 128-bit hash of the set, its sketch and minwise values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches, most=CHUNK_BYTES):
            hashes, bounds = shingles(*arrays.text_bytes(table["text"]), size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            starts = bounds[:-1][full]
            keys = map(pa.array, _keys(hashes, bounds))
            signature = signatures(hashes, np.append(starts, len(hashes)))
            sketch = np.zeros((len(n), 4), np.int64)
            sketch[full] = sketches(signature)
            width = signature.shape[1] * signature.itemsize
            off = np.zeros(len(n) + 1, np.int32)
            off[1:] = np.cumsum(np.where(n > 0, width, 0))
            coded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(signature.tobytes())])
            columns = [arrays.plain(table["doc_id"]), pa.array(n), *keys, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)), coded]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", *SKETCH, "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, signature binary")


def _signature_of(column) -> np.ndarray:
    data, _ = arrays.text_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(-1, POSITIONS)


def _rooted(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """``node, cls`` of every class at a depth of every tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _signature_of(batch["signature"])
            for tree in range(trees):
                row = np.arange(len(signature))
                node = np.full(len(row), arrays.mix(np.array([tree + 1], np.uint64))[0], np.uint64).view(np.int64)
                for _ in range(depth):
                    moved, node = branch(node, signature[row])
                    row = row[moved]
                yield pa.RecordBatch.from_arrays([pa.array(node), batch["cls"].take(pa.array(row))], ["node", "cls"])

    return classes.select("cls", "signature").mapInArrow(run, "node bigint, cls bigint")


def _deeper(rows: DataFrame, classes: DataFrame, copies: int) -> DataFrame:
    """The rows' nodes STEP levels down."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _signature_of(batch["signature"])
            row, node = subtrees(batch["node"].to_numpy(), signature, copies)
            yield pa.RecordBatch.from_arrays([pa.array(node), batch["cls"].take(pa.array(row))], ["node", "cls"])

    joined = rows.select("node", "cls").join(classes.select("cls", "signature"), "cls").select("node", "cls", "signature")
    return joined.mapInArrow(run, "node bigint, cls bigint")


def _most(similarity: float) -> int:
    """The most bits in which the sketches of rows of the similarity may differ."""
    # Unequal minwise values have unequal bits half of the time: with two bits of each value
    # the share of unequal bits has this mean and variance.
    unequal = 1 - similarity
    mean = unequal / 2
    deviation = math.sqrt((unequal * (1 - unequal) / 4 + unequal / 8) / POSITIONS)
    return math.floor(2 * POSITIONS * (mean + SPREAD * deviation))


def _alike(a: str, b: str, similarity: float):
    """Whether two rows' sizes and sketches allow the similarity."""
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(1, 4)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (differ <= _most(similarity)) & (low >= similarity * high - 1e-6 * high)


def _nodes(live: DataFrame) -> DataFrame:
    """Nodes with several components: their size, the largest, ``top``, and the number of rows outside it, ``others``."""
    parts = live.groupBy("node", "component").agg(F.count("*").alias("rows"))
    found = parts.groupBy("node").agg(F.sum("rows").alias("size"), F.max(F.struct("rows", "component")).alias("l"))
    return found.select("node", "size", F.col("l.component").alias("top"), (F.col("size") - F.col("l.rows")).alias("others")).filter("others > 0")


def _crowded(live: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of nodes with several components, with their sizes and sketches."""
    rows = live.join(_nodes(live), "node")
    return rows.join(classes.select("cls", "n", *SKETCH), "cls").select("node", "cls", "component", "size", "top", "others", "n", *SKETCH)


def whole_groups(batches: Iterable[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows but for the last, none of which ends amid equal values of a column."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table[column].to_numpy()
            whole = len(key) - int((key[::-1] != key[-1]).argmax()) if (key != key[-1]).any() else 0  # the last group may go on
            if whole:
                yield table.slice(0, whole)
            held, rows = table.slice(whole).to_batches(), table.num_rows - whole
            wanted = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining each x with its y; a label is the least number of those joined."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
    return label


def _joins(names: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(names[label[moved]]), pa.array(names[moved])], ["a", "b"])


def _compared(nodes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: components to join, as rows of theirs in one node and slot allow the similarity."""
    most = _most(similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", TASK_ROWS):
            key, n = table["key"].to_numpy(), table["n"].to_numpy()
            sketch = [table[c].to_numpy().view(np.uint64) for c in SKETCH]
            names, own = np.unique(table["component"].to_numpy(), return_inverse=True)
            label = np.arange(len(names))
            end = np.searchsorted(key, key, side="right")
            # A node's largest component comes last: all others meet what follows them.
            x = np.flatnonzero(~table["main"].to_numpy(zero_copy_only=False))
            upto = np.cumsum(end[x] - x - 1)
            at = 0
            while at < len(x):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
                part = x[at:to]
                a = np.repeat(part, end[part] - part - 1)
                b = arrays.ragged(end[part] - part - 1, part + 1)
                able = (label[own[a]] != label[own[b]]) & (np.minimum(n[a], n[b]) >= (similarity - 1e-6) * np.maximum(n[a], n[b]))
                a, b = a[able], b[able]
                differ = sum(np.bitwise_count(s[a] ^ s[b]).astype(np.int16) for s in sketch)
                label = united(label, own[a[differ <= most]], own[b[differ <= most]])
                at = to
            yield _joins(names, label)

    dealt = nodes.repartition("key").sortWithinPartitions("key", "main")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _like(crowded: DataFrame, similarity: float, last: bool) -> DataFrame:
    """``a, b``: components to join, so that the similar rows of small nodes are in one.

    Rows outside a node's largest component are compared with all of the node.
    Nodes with too many such rows compare all with a few members.
    """
    rows = (crowded if last else crowded.filter(F.col("others") <= SMALL)).withColumn("main", F.col("component") == F.col("top"))
    columns = ["main", "component", "n", *SKETCH]
    one = rows.filter(F.col("size") <= NODE_ROWS).select(F.col("node").alias("key"), *columns)
    slots = F.ceil(F.col("size") / NODE_ROWS)
    slot = F.when(F.col("main"), F.array(F.pmod(F.xxhash64("cls"), slots))).otherwise(F.sequence(F.lit(0).cast("long"), slots - 1))
    more = rows.filter(F.col("size") > NODE_ROWS).withColumn("slot", F.explode(slot)).select(F.xxhash64("node", "slot").alias("key"), *columns)
    found = _compared(one.unionByName(more), similarity)
    if last:
        return found
    apart = F.col("x.component") != F.col("y.component")
    large = crowded.filter(F.col("others") > SMALL).select("node", "cls", "component", "n", *SKETCH)
    member = F.struct("cls", "n", *SKETCH, "component")
    pivots = [F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("o"), member.alias("m")))["m"] for k in range(PIVOTS)]
    met = large.join(large.groupBy("node").agg(F.array(*pivots).alias("ps")), "node")
    star = met.select(F.struct(*large.columns).alias("x"), F.explode("ps").alias("y")).filter(apart & _alike("x", "y", similarity))
    return found.unionByName(star.select(F.col("x.component").alias("a"), F.col("y.component").alias("b")))


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    named = found.select(F.col("node").alias("cls"), "component")
    return rows.select("node", "cls").join(named, "cls", "left").select("node", "cls", F.coalesce("component", "cls").alias("component"))


def _next(large: DataFrame, found: DataFrame, classes: DataFrame, copies: int) -> DataFrame:
    """Large nodes that have few rows outside one component by now, and what the others branch to."""
    rows = _with_component(large, found)
    sized = rows.join(_nodes(rows).select("node", "others"), "node")
    stay = sized.filter(F.col("others") <= SMALL).select("node", "cls", "component")
    go = _deeper(sized.filter(F.col("others") > SMALL), classes, copies)
    return stay.unionByName(_with_component(go, found))


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The two halves of a 128-bit hash of every set, whatever its order."""
    full = np.flatnonzero(np.diff(bounds))
    keys = []
    for seed in (np.uint64(3), np.uint64(5)):
        key = np.zeros(len(bounds) - 1, np.uint64)
        if len(full):
            key[full] = np.add.reduceat(arrays.mix(hashes * _GOLDEN + seed), bounds[:-1][full])
        keys.append(key.view(np.int64))
    return keys


def _nameless(k1: np.ndarray) -> np.ndarray:
    """Numbers for classes without any id."""
    return _NAMELESS + (k1.view(np.uint64) >> np.uint64(3)).astype(np.int64)


def _texts(docs: DataFrame, size: int) -> DataFrame:
    """``cls, text``: every row by its id, or by the number of its class without any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches, most=CHUNK_BYTES):
            numbers = _nameless(_keys(*shingles(*arrays.text_bytes(table["text"]), size))[0])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), arrays.plain(table["text"])], ["cls", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").cast("string").alias("text"))
    return rows.filter("cls is not null").unionByName(rows.filter("cls is null").select("text").mapInArrow(run, "cls bigint, text string"))


def common_sizes(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For rows i < j the number of hashes that both have; a row has none twice."""
    order = np.argsort(hashes, kind="stable")
    hashes, row = hashes[order], row[order]
    new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
    count = np.diff(np.append(np.flatnonzero(new), len(hashes)))
    per = np.repeat(count, count)
    few = FEW if rows > 64 else 1
    out = np.zeros((rows, rows), np.int32)
    rare = (per > 1) & (per <= few)
    for k in range(1, few):
        own, value = row[rare], hashes[rare]
        both = np.flatnonzero(value[k:] == value[:-k])
        np.add.at(out, (own[both], own[both + k]), 1)
    often = per > few
    number, own = np.cumsum(new[often]) - 1, row[often]
    width = max(1, CELLS // max(rows, 1))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        k = slice(*np.searchsorted(number, [a, a + width]))
        has = np.zeros((rows, min(width, int(number[-1]) + 1 - a)), np.float32)
        has[own[k], number[k] - a] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def _verified(docs: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: classes to join, as their full sets reach the similarity; ``dealt`` has the groups of each, ``cls, key``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", BLOCK):
            found = [shingles(*arrays.text_bytes(t["text"]), size) for t in arrays.chunks(table.select(["text"]).to_batches(), most=CHUNK_BYTES)]
            hashes, n = np.concatenate([h for h, _ in found]), np.concatenate([np.diff(b) for _, b in found])
            bounds = np.concatenate([[0], np.cumsum(n)])
            names, own = np.unique(table["cls"].to_numpy(), return_inverse=True)
            label, key = np.arange(len(names)), table["key"].to_numpy()
            same = np.stack([*_keys(hashes, bounds), own, key])
            order = np.lexsort(same)
            again = order[1:][(same[:, order[1:]] == same[:, order[:-1]]).all(0)]
            if len(again):  # rows that repeat an id and a set
                left = np.delete(np.arange(len(key)), again)
                hashes = hashes[arrays.ragged(n[left], bounds[left])]
                key, own, n = key[left], own[left], n[left]
                bounds = np.concatenate([[0], np.cumsum(n)])
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    both = common_sizes(hashes[bounds[a] : bounds[b]], np.repeat(np.arange(b - a), n[a:b]), b - a)
                    for x in range(b - a - 1):
                        common, rest = both[x, x + 1 :], n[a + x] + n[a + x + 1 : b]
                        y = np.flatnonzero((common > 0) & ((100 + percent) * common.astype(np.int64) >= percent * rest)) + x + 1
                        if len(y):
                            label = united(label, np.full(len(y), own[a + x]), own[a + y])
            yield _joins(names, label)

    rows = _texts(docs, size).join(dealt, "cls").select("key", "cls", "text")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _blocks(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """``family`` and the number of blocks for its rows."""
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    return rows.groupBy(by).agg(many.alias(kind))


def _numbers(count: str):
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _components_of(docs: DataFrame, classes: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` of the classes whose full sets are linked, from the families that may be."""
    named = families.select(F.col("node").alias("cls"), F.col("component").alias("family"))
    named = named.unionByName(families.select(F.col("component").alias("cls"), F.col("component").alias("family")).distinct())
    rows = written(named.join(classes.groupBy("cls").agg(F.sum("n").alias("n")), "cls"), "families")
    pivots = [F.min_by("cls", F.xxhash64("cls", F.lit(k))) for k in range(PIVOTS)]
    sized = _blocks(rows, "family", "blocks").filter("blocks > 1")
    large = written(rows.join(sized, "family"), "large")
    key = F.xxhash64("family", "block").alias("key")
    dealt = rows.join(sized, "family", "left_anti").select("cls", F.col("family").alias("key"))
    if large.isEmpty():
        return components(_verified(docs, dealt, size, percent), "components")
    parts = large.join(large.groupBy("family").agg(F.array(*pivots).alias("ps")), "family")
    own = F.when(F.array_contains("ps", F.col("cls")), _numbers("blocks")).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    parts = parts.select("cls", "family", F.explode(own).alias("block")).select("cls", key)
    found = components(_verified(docs, dealt.unionByName(parts), size, percent), "components")
    # What is left of the large families: rows outside the largest component, with all.
    of = found.select(F.col("node").alias("cls"), "component")
    large = written(large.join(of, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "large")
    top = large.groupBy("family", "component").agg(F.count("*").alias("rows")).groupBy("family").agg(F.max_by("component", F.struct("rows", "component")).alias("top"))
    left = large.join(top, "family").filter("component <> top").select("cls", "family", "n", "blocks")
    wide = _blocks(left, "family", "others")
    pair = F.xxhash64("family", "block", "other").alias("key")
    block, other = (F.pmod(F.xxhash64("cls", F.lit(k)), F.col(c)) for k, c in ((1, "blocks"), (2, "others")))
    whole = large.join(wide, "family").withColumn("block", block).withColumn("other", F.explode(_numbers("others")))
    apart = left.join(wide, "family").withColumn("other", other).withColumn("block", F.explode(_numbers("blocks")))
    again = written(whole.select("cls", pair).unionByName(apart.select("cls", pair)).distinct(), "again")
    if again.isEmpty():
        return found
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(_verified(docs, again, size, percent).unionByName(known), "components")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Documents whose shingle sets have at least ``percent`` % in common are
    linked; ``component_id`` is the smallest id reachable over links.
    """
    similarity = percent / 100
    described = written(_described(docs, size), "described")
    full = described.filter("n > 0")
    name = F.coalesce(F.min("doc_id"), F.lit(_NAMELESS) + F.shiftrightunsigned(F.first("k1"), 3))
    classes = full.groupBy("k1", "k2").agg(name.alias("cls"), *(F.first(c).alias(c) for c in ("n", *SKETCH, "signature")))
    classes = written(classes, "classes")
    total = classes.count()
    # Unlike sets share about one minwise value in twenty at most, so a tree this deep parts them.
    depth = round(math.log(max(1, total)) / math.log(20)) if total > SMALL else 0
    trees = trees_for(similarity, depth) if depth else 1
    live = _rooted(classes, trees, depth).withColumn("component", F.col("cls"))
    families = None
    for level in range(depth, DEEPEST + 1, STEP):
        last = level + STEP > DEEPEST
        crowded = written(_crowded(live, classes), "crowded")
        known = [] if families is None else [families.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        families = components(reduce(DataFrame.unionByName, known, _like(crowded, similarity, last)), "families")
        large = crowded.filter(F.col("others") > SMALL).select("node", "cls")
        if last or large.isEmpty():
            break
        live = written(_next(large, families, classes, copies_of(similarity)), "live")
    found = _components_of(docs, classes, families, size, percent)
    named = classes.join(found, classes.cls == found.node, "left").select("k1", "k2", F.coalesce("component", "cls").alias("component"))
    named = named.select("k1", "k2", F.when(F.col("component") < _NAMELESS, F.col("component")).alias("component"), F.lit(True).alias("named"))
    out = described.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    # A document without a set is a component of its own; the key of the empty set matches no class.
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

