"""Places and running totals along a global order, without a task that holds a group.

Rows are dealt into ranges of their order and sorted there; each task walks its
range once, batch by batch, and starts anew where the group changes.  Only the
first group of a range can have begun in an earlier one, so one row per range
tells what it carries on from there.  A group may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessella.llm.shared import written


def _walk(group: list[str], sums: list[str], xors: list[str], lag: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, head = TaskContext.get().partitionId(), 0, True
        last: list = []
        place, totals, masks, before = 0, [0] * len(sums), [0] * len(xors), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for i, name in enumerate(group):
                column = batch.column(batch.schema.get_field_index(name))
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] |= bool(last) and column[0].as_py() != last[i]
            last = [batch.column(batch.schema.get_field_index(name))[n - 1].as_py() for name in group]
            index = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, index, -1))  # -1: goes on from the batch before
            within = index - np.maximum(begin, 0) + np.where(begin < 0, place, 0)
            heads = head & (begin < 0)
            out = [pa.array(np.full(n, part)), pa.array(seen + index), pa.array(heads), pa.array(within)]
            place, head, seen = int(within[-1]) + 1, bool(heads[-1]), seen + n
            for held, names, total in ((totals, sums, np.add), (masks, xors, np.bitwise_xor)):
                for k, name in enumerate(names):
                    values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                    run_ = total.accumulate(values)
                    start = np.where(begin > 0, run_[np.maximum(begin, 1) - 1], 0)
                    run_ = total(run_ - start if total is np.add else run_ ^ start, np.where(begin < 0, held[k], 0))
                    held[k] = int(run_[-1])
                    out.append(pa.array(run_))
            if lag:
                values = batch.column(batch.schema.get_field_index(lag))
                moved = pa.concat_arrays([pa.array([before], values.type), values.slice(0, n - 1)])
                out.append(pc.if_else(pa.array(new), pa.scalar(None, values.type), moved))
                before = values[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *_added(sums, xors, lag)])

    return run


def _added(sums: list[str], xors: list[str], lag: str | None) -> list[str]:
    return ["_part", "_index", "_head", "pos", *(f"{c}_sum" for c in sums), *(f"{c}_xor" for c in xors), *(["lag"] if lag else [])]


def scan(
    rows: DataFrame, group: list[str], order: list[str], label: str, sums: list[str] | None = None, xors: list[str] | None = None, lag: str | None = None
) -> DataFrame:
    """``rows`` with ``pos``, the place in their group from 0 on, and running totals that include the row.

    ``group`` columns have no nulls; ``order`` tells rows of a group apart.  ``c_sum``
    and ``c_xor`` run over long columns without nulls, ``lag`` is a column's value
    in the row before it in the group.  The result is read from the shared folder.
    """
    sums, xors = sums or [], xors or []
    keys = [*group, *order]
    kinds = dict(rows.dtypes)
    schema = ", ".join(
        [f"`{c}` {t}" for c, t in rows.dtypes]
        + ["_part bigint", "_index bigint", "_head boolean", "pos bigint"]
        + [f"`{c}_sum` bigint" for c in sums] + [f"`{c}_xor` bigint" for c in xors] + ([f"lag {kinds[lag]}"] if lag else [])
    )
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    walked = written(dealt.mapInArrow(_walk(group, sums, xors, lag), schema), label)
    totals = ["pos", *(f"{c}_sum" for c in sums), *(f"{c}_xor" for c in xors)]
    end = F.struct(*group, *totals, "_head", *([lag] if lag else []))
    ends = walked.groupBy("_part").agg(F.min_by(F.struct(*group), "_index").alias("first"), F.max_by(end, "_index").alias("last"))
    carried, before, held, value = [], None, [], None
    for e in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row for each range
        goes_on = before == tuple(e["first"])
        begun = held if goes_on else [0] * len(totals)
        carried.append((e["_part"], *begun, value if goes_on else None))
        mine = [e["last"]["pos"] + 1, *(e["last"][c] for c in totals[1:])]
        if e["last"]["_head"]:
            mine = [a ^ b if c.endswith("_xor") else a + b for a, b, c in zip(mine, begun, totals, strict=True)]
        before, held, value = tuple(e["last"][c] for c in group), mine, e["last"][lag] if lag else None
    names = [f"_before_{c}" for c in totals]
    kind = ", ".join(["_part bigint", *(f"`{c}` bigint" for c in names), f"_value {kinds[lag] if lag else 'bigint'}"])
    table = F.broadcast(rows.sparkSession.createDataFrame(carried, kind))
    joined = walked.join(table, "_part", "left")
    add = lambda c: F.when(F.col("_head"), (F.col(c).bitwiseXOR if c.endswith("_xor") else F.col(c).__add__)(F.col(f"_before_{c}"))).otherwise(F.col(c))
    out = [*(F.col(c) for c in rows.columns), *(add(c).alias(c) for c in totals)]
    if lag:
        out.append(F.when(F.col("_index") == 0, F.col("_value")).otherwise(F.col("lag")).alias("lag"))
    return joined.select(*out)
