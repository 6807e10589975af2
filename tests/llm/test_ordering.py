from collections import defaultdict
from functools import reduce

import pytest

from tessella.llm.ordering import scan


@pytest.mark.parametrize("parts, batch", [(1, 3), (9, 10_000), (40, 2)])
def test_scan_matches_brute_force(spark, parts, batch):
    rows = [(g, k, (k * 7919 + g) % 1000 - 300) for g in range(6) for k in range([0, 1, 3, 400, 2, 90][g])]
    rows += [(4, 1, 5), (4, 1, 5)]
    table = spark.createDataFrame([(g, k, v, i) for i, (g, k, v) in enumerate(rows)], "g bigint, k bigint, v bigint, row bigint").repartition(5)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = scan(table, ["g"], ["k", "row"], "scan", ["v"], ["v"], "row").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    groups = defaultdict(list)
    for i, (g, k, v) in enumerate(rows):
        groups[g].append((k, i, v))
    want = set()
    for g, members in groups.items():
        members.sort()
        for n, (k, i, v) in enumerate(members):
            values = [m[2] for m in members[: n + 1]]
            want.add((g, k, v, i, n, sum(values), reduce(lambda a, b: a ^ b, values), members[n - 1][1] if n else None))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_scan_of_nothing(spark):
    table = spark.createDataFrame([], "g bigint, k bigint")
    assert scan(table, ["g"], ["k"], "scan", lag="k").columns == ["g", "k", "pos", "lag"]
    assert scan(table, ["g"], ["k"], "scan", lag="k").count() == 0
