"""Places in linked lists that are spread over many tasks.

Elements name the one before them.  In a round every element tosses a coin by
its number; one with heads takes in the one before it if that has tails, which
leaves the list with a note of whom it followed.  A round is one join and leaves
about three quarters of the elements, so all rounds together move a fixed multiple of
the list.  At most BASE elements are ranked by one task; then the rounds are
undone in turn, each by one join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.shared import written

BASE = 1 << 15


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a short list, by doubling the distance that each element looks back."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids = table["id"].to_numpy()
    by_id = np.argsort(ids)
    before = table["before"].fill_null(-1).to_numpy()
    at = np.minimum(np.searchsorted(ids, before, sorter=by_id), len(ids) - 1)
    back = np.where(ids[by_id[at]] == before, by_id[at], -1)
    upto = table["size"].to_numpy().copy()
    while (back >= 0).any():
        upto = upto + np.where(back >= 0, upto[back], 0)
        back = np.where(back >= 0, back[back], -1)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(upto)], names=["id", "upto"])


def ranked(elements: DataFrame, base: int = BASE, label: str = "list") -> DataFrame:
    """``id, upto`` from ``id, before, size``: the sizes of all elements up to and with this one.

    ``before`` is the element before this one, null for a list's first; ids are not negative.
    """
    now, left, size = written(elements.select("id", "before", "size"), label), [], None
    while size is None or size > base:
        if size is not None:
            coin = F.xxhash64("id", F.lit(len(left))) % 2 == 0
            taking = now.filter(coin).alias("a")
            taken = now.filter(~coin).alias("b")
            both = F.col("a.id").isNotNull() & F.col("b.id").isNotNull()
            joined = taking.join(taken, F.col("a.before") == F.col("b.id"), "full").select(
                F.coalesce("a.id", "b.id").alias("id"),
                F.when(F.col("b.id").isNotNull(), F.col("b.before")).otherwise(F.col("a.before")).alias("before"),
                (F.coalesce("a.size", F.lit(0)) + F.coalesce("b.size", F.lit(0))).alias("size"),
                *(F.when(both, F.col(f"b.{c}")).alias(f"left_{c}") for c in ("id", "before", "size")),
            )
            step = written(joined, f"{label}-{len(left)}")
            left.append(step.filter("left_id is not null").select(*(F.col(f"left_{c}").alias(c) for c in ("id", "before", "size"))))
            now = step.select("id", "before", "size")
        size = now.count()
    places = written(now.repartition(1).mapInArrow(_solve, "id bigint, upto bigint"), f"{label}-base")
    for gone in reversed(left):
        known = places.select(F.col("id").alias("before"), F.col("upto").alias("known"))
        back = gone.join(known, "before", "left").select("id", (F.coalesce("known", F.lit(0)) + F.col("size")).alias("upto"))
        places = written(places.unionByName(back), f"{label}-back")
    return places
