"""Prefix trie of conversations, measured along its Euler tour.

A node is a distinct sequence of first turns; conversations that begin with it
are its members, and the smallest of them with the depth names it.  A prefix is
known by its depth and the XOR of two hashes of each turn with its place,
a running total along the turns in order.  Members of a node must agree on their last turn
and on the node before it, which by induction makes the sequences equal; if a
hash ever joined unlike ones, the job fails.

Every node has an arc that enters it and one that leaves it.  The tour visits
children by their smallest member, so each arc knows the one before it: leaving
the previous child or entering the parent, and leaving the last child or entering the
node itself.  Stretches of arcs of one member within STRETCH depths are joined
in place, the list of stretches is ranked, and with it all arcs have positions.
Running sums over the arcs in that order give what lies in a subtree: the sum where its
node is left less that before it was entered.

No task holds a conversation, a node's members or its children: order, running
totals and neighbours come from ``ordering.scan``, members are counted by partial
aggregates.

Edge cases: turns are ordered by number, null first, then by a digest of role and text;
repeated rows are turns of their own; a null role or text is empty; turns without a
conversation belong to none; other columns are ignored; without conversations there are no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessella.llm.list_ranking import BASE, ranked
from tessella.llm.ordering import scan
from tessella.llm.shared import written

STRETCH = 10  # depths of a stretch, as a power of two
JOINED = 4096  # ids that are joined to one string before they are hashed
_LAST = 1 << 40


class Trie(NamedTuple):
    nodes: DataFrame  # id, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    ends: DataFrame  # id of a node, conv_id of a conversation that ends there


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, bytes``: the turns in order, from 0 on; ``a`` and ``b`` are 120 bits of SHA-256 of role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"), 256)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.octet_length(text("text")).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows.select("conv_id", "turn", _half(F.col("digest"), 1).alias("a"), _half(F.col("digest"), 16).alias("b"), "bytes", "row"), "turns")
    return scan(rows, ["conv_id"], ["turn", "a", "b", "row"], "ordered-turns").select("conv_id", "pos", "a", "b", "bytes")


def _prefixes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by depth and hash, each with the key of its parent, and the node at which each conversation ends."""
    hashes = [F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64(F.lit(17), "b", "a", "depth").alias("y")]
    run = scan(written(rows.select("*", *hashes), "rebuilt"), ["conv_id"], ["depth"], "prefixes", xors=["x", "y"])
    run = run.select(
        "conv_id", "depth", "a", "b", "bytes", F.col("x_xor").alias("kx"), F.col("y_xor").alias("ky"),
        F.col("x_xor").bitwiseXOR(F.col("x")).alias("px"), F.col("y_xor").bitwiseXOR(F.col("y")).alias("py"),
    )
    same = ["a", "b", "px", "py", "bytes"]
    nodes = run.groupBy("depth", "kx", "ky").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"max_{c}") for c in same)
    )
    unlike = F.lit(False)
    for c in same:
        unlike |= F.col(c) != F.col(f"max_{c}")
    nodes = nodes.withColumn("bytes", F.when(unlike, F.raise_error(F.lit("two prefixes have the same hashes"))).otherwise(F.col("bytes")))
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select("*", *zero("depth", "kx", "ky", "px", "py", "bytes"))
    nodes = nodes.select(*root.columns).unionByName(root)
    last = run.groupBy("conv_id").agg(F.max_by(F.struct("depth", "kx", "ky"), "depth").alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"last.{c}"), F.lit(0)).alias(c) for c in ("depth", "kx", "ky")))
    return nodes, ends


def _related(nodes: DataFrame) -> DataFrame:
    """Nodes with a number, their parent, the sibling before them and their last child."""
    numbered = written(nodes.select("*", F.monotonically_increasing_id().alias("id")), "nodes")
    placed = scan(numbered, ["depth", "px", "py"], ["conv_id"], "siblings", lag="id")
    up = (F.col("depth") - 1).alias("depth")
    down = placed.groupBy(up, F.col("px").alias("kx"), F.col("py").alias("ky")).agg(
        F.count("*").alias("n_children"), F.max("conv_id").alias("last_conv"), F.max_by("id", "conv_id").alias("last_id")
    )
    parents = numbered.select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = placed.join(parents, ["depth", "px", "py"], "left").join(down, ["depth", "kx", "ky"], "left")
    return written(found.select(
        "id", "conv_id", "depth", "kx", "ky", "n_convs", "bytes", "parent", "parent_conv_id", F.col("lag").alias("sibling"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "last_conv", "last_id",
    ), "trie")


def _arcs(nodes: DataFrame) -> DataFrame:
    """Two arcs for each node, with the arc before, joined to stretches: ``tail`` and ``size`` of its stretch, and its ``place`` there from 1 on."""
    within = lambda d: d % (1 << STRETCH) != 0
    id, depth, childless = F.col("id"), F.col("depth"), F.col("n_children") == 0
    entered = F.when(F.col("sibling").isNotNull(), F.col("sibling") * 2 + 1).otherwise(F.col("parent") * 2)
    own_first = F.col("sibling").isNull() & F.coalesce(F.col("parent_conv_id") == F.col("conv_id"), F.lit(False)) & within(depth)
    left = F.when(childless, id * 2).otherwise(F.col("last_id") * 2 + 1)
    own_last = childless | (F.coalesce(F.col("last_conv") == F.col("conv_id"), F.lit(False)) & within(depth + 1))
    zero = F.lit(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    enter = F.struct((id * 2).alias("arc"), entered.alias("before"), depth.alias("turn"), own_first.alias("joined"), F.when(childless, 1).otherwise(0).cast("long").alias("leaf"), saved.alias("saved"))
    leave = F.struct((id * 2 + 1).alias("arc"), left.alias("before"), (_LAST - depth).alias("turn"), own_last.alias("joined"), zero.alias("leaf"), zero.alias("saved"))
    part = ["conv_id", "stretch"]
    arcs = nodes.select("conv_id", F.shiftright("depth", STRETCH).alias("stretch"), F.explode(F.array(enter, leave)).alias("arc")).select(*part, "arc.*")
    run = F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(Window.partitionBy(*part).orderBy("turn"))
    order = Window.partitionBy(*part, "run").orderBy("turn")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arcs = arcs.withColumn("run", run)
    return arcs.select(
        "arc", "leaf", "saved", F.row_number().over(order).cast("long").alias("place"), F.count("*").over(whole).alias("size"),
        F.last("arc").over(whole).alias("tail"), F.first("before").over(whole).alias("before"),
    )


def trie(rows: DataFrame, convs: DataFrame, base: int = BASE) -> Trie:
    """The trie of turns ``conv_id, depth, a, b, bytes`` (depths from 1 on) of all conversations ``conv_id``."""
    nodes, ends = _prefixes(rows, convs)
    nodes = _related(nodes)
    arcs = written(_arcs(nodes), "arcs")
    places = ranked(arcs.filter("place = size").select(F.col("tail").alias("id"), "before", "size"), base, "stretches")
    toured = arcs.join(places.withColumnRenamed("id", "tail"), "tail").select(
        F.lit(0).cast("long").alias("tour"), (F.col("upto") - F.col("size") + F.col("place")).alias("at"), "arc", "leaf", "saved"
    )
    sums = scan(written(toured, "tour"), ["tour"], ["at"], "sums", sums=["leaf", "saved"])
    leaving = F.col("arc") % 2 == 1
    inside = lambda c: F.sum(F.when(leaving, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum")))
    subtree = sums.groupBy(F.shiftright("arc", 1).alias("id")).agg(inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"))
    found = nodes.join(subtree, "id").select("id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    key = ["depth", "kx", "ky"]
    return Trie(found, ends.join(nodes.select("id", *key), key).select("id", "conv_id"))


def of(conversations: DataFrame) -> Trie:
    """The trie of the conversations as they are."""
    rows = turns(conversations)
    found = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "bytes")
    return trie(found, rows.select("conv_id").distinct())


def _strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order to comma-joined strings of at most JOINED ids of one key."""
    from pyspark import TaskContext

    part, place, key, held = TaskContext.get().partitionId(), 0, None, []

    def string() -> pa.RecordBatch:
        names = ["id", "part", "place", "ids"]
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part]), pa.array([place]), pa.array([",".join(map(str, held))])], names=names)

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or len(held) == JOINED):
                out.append(string())
                place, held = place + 1, []
            key = k
            held.append(value)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if held:
        yield string()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each key, fed string by string."""
    key, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["id", "sha256"])
    for batch in batches:
        out = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append(row())
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if key is not None:
        yield row()


def id_digests(ends: DataFrame) -> DataFrame:
    """``id, sha256`` of each key's comma-joined, ascending conversations.

    Ids are ordered and joined to strings by many tasks; a key's strings are hashed one after the other, as
    SHA-256 can't be split, but without being held.
    """
    ordered = written(ends, "ends").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    strings = written(ordered.mapInArrow(_strings, "id bigint, part bigint, place bigint, ids string"), "strings")
    dealt = strings.repartition("id").sortWithinPartitions("id", "part", "place")
    return dealt.select("id", "ids").mapInArrow(_hashed, "id bigint, sha256 string")
