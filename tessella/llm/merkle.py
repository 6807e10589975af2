"""Merkle manifest of a dataset in a persistent tree, with a version for every tampered leaf.

A row's leaf is the SHA-256 of its encoded columns.  Leaves of a group ascend by
id; two nodes in a row make the next one, a lone last node too, until one is
left, the group's subroot.  Subroots in order of their groups make the root alike.

The tree is cut into aligned blocks of 2**LEVELS nodes.  A floor is one block high:
every block is built by a task of its own and its root is a node of the floor
above.  In a block, nodes are kept in a store that only grows: a version of a
changed leaf copies the leaf's ancestors and points to the untouched nodes of the
first tree for all others.  A version's block root then is a changed node of the
floor above, where versions go on in chunks of 2**CHUNK leaf positions, each with its
block's nodes beside it, so that no task holds all versions of an upper block.  Positions come
from a scan of the rows in order; a group may be of any size.

Edge cases: a null column is encoded apart from any value; null ids come first,
equal ids are ordered by leaf, and rows that are the same by the order read; null
groups come before all others; other columns are ignored; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.ordering import scan
from tessella.llm.shared import written

LEVELS = 10  # of a block
CHUNK = 12  # versions go up in chunks of 2**CHUNK leaf positions
HELD = 4096  # versions whose nodes a task keeps at once


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """A row's leaf, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(encoded(c) for c in columns)).cast("binary"), 256))


class Store:
    """A block's nodes as hex digests with the nodes they are made of; nodes are never changed."""

    def __init__(self, leaves: list[str], levels: int):
        self.digest, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        self.levels, row = levels, list(range(len(leaves)))
        for _ in range(levels):
            row = [self.node(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        self.root, self.size = row[0], len(self.digest)

    def node(self, left: int, right: int) -> int:
        both = self.digest[left] + (self.digest[right] if right >= 0 else "")
        self.digest.append(hashlib.sha256(both.encode()).hexdigest())
        self.left.append(left)
        self.right.append(right)
        return len(self.digest) - 1

    def path(self, place: int) -> list[tuple[int, bool]]:
        """The ancestors of a leaf from the root down, and whether it lies to their right."""
        at, found = self.root, []
        for level in reversed(range(self.levels)):
            to_right = bool(place >> level & 1)
            found.append((at, to_right))
            at = self.right[at] if to_right else self.left[at]
        return found

    def changed(self, place: int, digest: str) -> int:
        """The root of a version with another leaf; all nodes off its path are shared."""
        path = self.path(place)
        self.digest.append(digest)
        self.left.append(-1)
        self.right.append(-1)
        at = len(self.digest) - 1
        for above, to_right in reversed(path):
            at = self.node(self.left[above], at) if to_right else self.node(at, self.right[above])
        return at

    def forget(self) -> None:
        """Drop the nodes of all versions."""
        for nodes in (self.digest, self.left, self.right):
            del nodes[self.size :]

    def siblings(self, place: int) -> tuple[str, str]:
        """Digests beside a leaf's path, from the leaf up, and for each level the side they lie on, - for a lone node."""
        beside = [(self.left[at], "L") if to_right else (self.right[at], "R") for at, to_right in reversed(self.path(place))]
        return "".join(self.digest[n] for n, _ in beside if n >= 0), "".join(side if n >= 0 else "-" for n, side in beside)


_NODES = "grp string, pos bigint, digest binary, path string, sides string, packed binary"
_VERSIONS = "grp string, rank bigint, row bigint, digest binary"
_ROWS = "row bigint, doc_id bigint, leaf binary, subroot string, proof string, sides string, folded_root string"


class Blocks:
    """What a task does with one aligned block of ``2**levels`` nodes; blocks come and go as Arrow tables."""

    def __init__(self, levels: int):
        self.levels = levels

    def store(self, block: int, digests: list[bytes]) -> Store:
        """Only a group's first block can be all of the group; any other is built to full height."""
        height = (len(digests) - 1).bit_length() if block == 0 else self.levels
        return Store([d.hex() for d in digests], height)

    @staticmethod
    def folded(store: Store, changes: Iterable[tuple[int, bytes]]) -> list[bytes]:
        """Roots of the versions of ``changes``."""
        out = []
        for n, (place, digest) in enumerate(changes):
            if n % HELD == 0:
                store.forget()
            out.append(bytes.fromhex(store.digest[store.changed(place, digest.hex())]))
        return out

    def leaves(self, key, table):
        """A block of leaves: the changed roots of its versions, and in the row without a number its root."""
        grp, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by("pos")
        store = self.store(block, table["digest"].to_pylist())
        changed = [(i, r, c) for i, (r, c) in enumerate(zip(table["row"].to_pylist(), table["changed"].to_pylist())) if c is not None]
        roots = self.folded(store, [(i, c) for i, _, c in changed])
        ranks = [(block << self.levels) + i for i, _, _ in changed]
        root = bytes.fromhex(store.digest[store.root])
        return pa.table(
            {
                "grp": pa.array([grp] * (len(roots) + 1), pa.string()), "rank": pa.array([*ranks, block], pa.int64()),
                "row": pa.array([*(r for _, r, _ in changed), None], pa.int64()), "digest": pa.array([*roots, root], pa.binary()),
            }
        )

    def upper(self, key, table):
        """A block of upper nodes: each with what lies beside its path, and the block's root with all of its nodes."""
        grp, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by("pos")
        digests, n = table["digest"].to_pylist(), table.num_rows
        store = self.store(block, digests)
        beside = [store.siblings(i) for i in range(n)]
        root = bytes.fromhex(store.digest[store.root])
        return pa.table(
            {
                "grp": pa.array([grp] * (n + 1), pa.string()), "pos": pa.array([*table["pos"].to_pylist(), block], pa.int64()),
                "digest": pa.array([*digests, root], pa.binary()),
                "path": pa.array([*(p for p, _ in beside), None], pa.string()), "sides": pa.array([*(s for _, s in beside), None], pa.string()),
                "packed": pa.array([None] * n + [b"".join(digests)], pa.binary()),
            }
        )

    def go_on(self, floor: int):
        """Versions of a chunk of leaves, continued through the block of ``floor`` that the chunk lies in."""

        def run(key, versions, base):
            packed, block, place = (base[c][0].as_py() for c in ("packed", "block", "place"))
            store = self.store(block, [packed[i : i + 32] for i in range(0, len(packed), 32)])
            places = [place if place is not None else (r >> (self.levels * floor)) % (1 << self.levels) for r in versions["rank"].to_pylist()]
            roots = self.folded(store, zip(places, versions["digest"].to_pylist()))
            return versions.select(["grp", "rank", "row"]).append_column("digest", pa.array(roots, pa.binary()))

        return run

    def proven(self, key, rows, above):
        """A block's rows with their proofs up to the root, and the roots of their versions."""
        rows = rows.sort_by("pos")
        store = self.store(key[1].as_py(), rows["digest"].to_pylist())
        up = {r: rest for r, *rest in zip(*(above[c].to_pylist() for c in ("row", "digest", "path", "sides", "subroot")))}
        _, path, sides, subroot = up[None]
        beside = [store.siblings(i) for i in range(rows.num_rows)]
        folded = [up[r][0].hex() if r in up else None for r in rows["row"].to_pylist()]
        return pa.table(
            {
                "row": rows["row"], "doc_id": rows["doc_id"], "leaf": rows["digest"].cast(pa.binary()),
                "subroot": pa.array([subroot] * rows.num_rows, pa.string()), "proof": pa.array([p + path for p, _ in beside], pa.string()),
                "sides": pa.array([s + sides for _, s in beside], pa.string()), "folded_root": pa.array(folded, pa.string()),
            }
        )


class _Floors:
    """The distributed part: floors of blocks, and the versions between them."""

    def __init__(self, levels: int, chunk: int):
        self.levels, self.chunk, self.blocks = levels, chunk, (blocks := Blocks(levels))
        # Spark takes functions here, not methods.
        self.leaves, self.upper = (lambda key, table: blocks.leaves(key, table)), (lambda key, table: blocks.upper(key, table))
        self.proven = lambda key, rows, above: blocks.proven(key, rows, above)

    def built(self, nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """Nodes with their paths in their block, and the blocks."""
        found = written(nodes.groupBy("grp", F.shiftright("pos", self.levels).alias("block")).applyInArrow(self.upper, _NODES), label)
        return found.filter("packed is null"), found.filter("packed is not null")

    def continued(self, versions: DataFrame, blocks: DataFrame, chunks: DataFrame, floor: int, label: str) -> DataFrame:
        """``versions`` at the next floor; ``chunks`` says which block (``of``, ``block``) each chunk is in and, if it is the same for all, at which ``place``."""
        base = chunks.join(blocks.select(F.col("grp").alias("of"), F.col("pos").alias("block"), "packed"), ["of", "block"])
        left = versions.withColumn("chunk", F.shiftright("rank", self.chunk)).groupBy("grp", "chunk")
        return written(left.cogroup(base.groupBy("grp", "chunk")).applyInArrow(self.blocks.go_on(floor), _VERSIONS), label)


def manifest(rows: DataFrame, levels: int = LEVELS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, sides, folded_root`` from ``doc_id, grp, leaf, changed``.

    ``changed`` is the leaf as it is found later, null where nothing changed.  Digests come as
    lower-case hex.  ``proof`` has those beside the leaf's path to the root one after the
    other, ``sides`` an L, R or, for a lone node, - for each level; ``folded_root`` is the root
    of the leaf's version.
    """
    if not levels <= chunk <= 2 * levels:
        raise ValueError("a chunk must hold whole blocks of leaves and lie in one block above")
    tree = _Floors(levels, chunk)
    grp = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit(""))  # null comes first
    base = rows.select(
        grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), "changed", F.monotonically_increasing_id().alias("row")
    )
    leaves = written(scan(written(base, "leaves"), ["grp"], ["doc_id", "digest", "row"], "ranked"), "placed")
    block = F.shiftright("pos", levels).alias("block")
    first = written(leaves.groupBy("grp", block).applyInArrow(tree.leaves, _VERSIONS), "blocks")
    versions = first.filter("row is not null")
    nodes = first.filter("row is null").select("grp", F.col("rank").alias("pos"), "digest")
    chunks = written(versions.select("grp", F.shiftright("rank", chunk).alias("chunk")).distinct(), "chunks")

    floors, floor = [], 1
    while nodes.filter("pos > 0").limit(1).count():
        below, blocks = tree.built(nodes, f"floor-{floor}")
        above = F.shiftright("chunk", levels * (floor + 1) - chunk).alias("block")
        of = chunks.select("grp", "chunk", F.col("grp").alias("of"), above, F.lit(None).cast("int").alias("place"))
        versions = tree.continued(versions, blocks, of, floor, f"versions-{floor}")
        nodes = blocks.select("grp", "pos", "digest")
        floors.append(below)
        floor += 1

    # The subroots are the leaves of a tree of their own.
    subroots = nodes.select(F.lit("").alias("all"), F.col("grp").alias("of_grp"), "digest")
    subroots = scan(subroots, ["all"], ["of_grp"], "subroots").select("of_grp", "pos", "digest")
    nodes, tops = subroots.select(F.lit("").alias("grp"), "pos", "digest"), []
    while not tops or nodes.filter("pos > 0").limit(1).count():
        below, blocks = tree.built(nodes, f"top-{len(tops)}")
        at = subroots.select(F.col("of_grp").alias("grp"), F.shiftright("pos", levels * len(tops)).alias("at"))
        of = chunks.join(at, "grp").select(
            "grp", "chunk", F.lit("").alias("of"), F.shiftright("at", levels).alias("block"), (F.col("at") % (1 << levels)).cast("int").alias("place")
        )
        versions = tree.continued(versions, blocks, of, 0, f"top-versions-{len(tops)}")
        nodes = blocks.select("grp", "pos", "digest")
        tops.append(below)

    root = nodes.select(F.lower(F.hex("digest")).alias("root")).first()
    above = _joined_down(tops, nodes.select("pos", F.lit("").alias("path"), F.lit("").alias("sides")), levels, [])
    subroot = F.lower(F.hex("digest")).alias("subroot")
    above = subroots.join(above, "pos").select(F.col("of_grp").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "sides", subroot)
    above = _joined_down(floors, above, levels, ["grp"], "subroot")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    beside = above.select("grp", F.col("pos").alias("block"), *none("bigint", "row"), *none("binary", "digest"), "path", "sides", "subroot")
    changes = versions.select("grp", F.shiftright("rank", levels).alias("block"), "row", "digest", *none("string", "path", "sides", "subroot"))
    proven = leaves.groupBy("grp", block).cogroup(beside.unionByName(changes).groupBy("grp", "block")).applyInArrow(tree.proven, _ROWS)
    whole = F.lit(root["root"] if root else None).cast("string")
    return proven.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", whole.alias("root"), "proof", "sides", F.coalesce("folded_root", whole).alias("folded_root")
    )


def _joined_down(floors: list[DataFrame], above: DataFrame, levels: int, by: list[str], *more: str) -> DataFrame:
    """Paths of the lowest floor's nodes, each with the path of its block after its own."""
    for floor in reversed(floors):
        up = above.select(*by, F.col("pos").alias("block"), F.col("path").alias("up_path"), F.col("sides").alias("up_sides"), *more)
        own = floor.select(*by, "pos", F.shiftright("pos", levels).alias("block"), "path", "sides")
        above = own.join(up, [*by, "block"]).select(*by, "pos", F.concat("path", "up_path").alias("path"), F.concat("sides", "up_sides").alias("sides"), *more)
    return above


def folded(leaf: Column, proof: Column, sides: Column) -> Column:
    """The root that a leaf's hex digest and its proof lead to."""
    level = F.transform(F.sequence(F.lit(1), F.length(sides)), lambda i: F.substring(sides, i, F.lit(1)))
    levels = F.when(sides == "", F.array().cast("array<string>")).otherwise(level)
    none = F.struct(leaf.alias("digest"), F.lit(1).alias("at"))

    def up(node: Column, side: Column) -> Column:
        beside = F.substring(proof, node["at"], F.lit(64))
        both = F.when(side == "L", F.concat(beside, node["digest"])).when(side == "R", F.concat(node["digest"], beside)).otherwise(node["digest"])
        return F.struct(F.sha2(both.cast("binary"), 256).alias("digest"), (node["at"] + F.when(side == "-", 0).otherwise(64)).alias("at"))

    return F.aggregate(levels, none, up, lambda n: n["digest"])
