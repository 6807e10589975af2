"""Ranks and texts of groups that no task holds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as g, ordered, prompt_texts as texts, templates


@pytest.fixture(params=[1, 13])
def parts(spark, request):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in held.items():
        spark.conf.set(k, v)


def groups():
    random.seed(6)
    rows = [(k, f"v{random.randrange(400)}") for k in ["a", "b", None] for _ in range(random.choice([3, 40]))]
    return rows + [("hot", f"w{i % 700}") for i in range(2000)] + [("none", None), ("ä", "é"), ("ä", "")]


def test_values_are_ranked_in_their_group(spark, parts):
    df = spark.createDataFrame(groups(), "k string, v string")
    want = defaultdict(set)
    for k, v in groups():
        if v is not None:
            want[k].add(v)
    got = sorted(((r.k, r.rank, r.v) for r in ordered.group_values(df, "k", "v").collect()), key=repr)
    assert got == sorted(((k, i, v) for k, vs in want.items() for i, v in enumerate(sorted(vs, key=str.encode))), key=repr)


def test_no_task_holds_a_hot_group(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"))
        spread = df.repartitionByRange("k", "v").groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) == 8 and max(r["count"] for r in spread) < 10_000
        assert ordered.group_values(df, "k", "v").agg(F.max("rank"), F.count_distinct("rank")).first()[:] == (39_999, 40_000)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_segments_put_together_are_the_text(spark, size):
    df = spark.createDataFrame(groups(), "k string, v string")
    found = ordered.joined_values(df, "k", "v", " | ", size).collect()
    text = defaultdict(str)
    for r in sorted(found, key=lambda r: r.segment):
        assert r.offset == len(text[r.k])
        text[r.k] += r.text
    want = {r.k: r.t for r in g.group_concat(df.filter("v is not null"), "k", "v", "t", " | ").collect()}
    assert text == want
    if size == 7:
        assert sum(r.k == "hot" for r in found) == 100


def test_sections_in_segments_are_the_sections(spark):
    rows = [("m", 1, f"P{i}", None, None, f"l{i}", texts.MANY if i % 2 else texts.ONE, "d", (i, 0, -1, -1)) for i in range(30)]
    rows += [("m", 2, f"P{i}", f"Q{k}", None, f"c{k}", texts.ONE, "e", (i, 0, k, -1)) for i in range(0, 30, 3) for k in range(4)]
    rows += [("n", 1, "P", None, None, "only", texts.ONE, "d", (0, 0, -1, -1))]
    schema = "mapping string, level int, path1 string, path2 string, path3 string, label string, cardinality string, description string, pos struct<t: int, p1: int, p2: int, p3: int>"
    df = spark.createDataFrame(rows, schema)
    whole = {r.mapping: (r.schema_section, r.hierarchy_section) for r in templates.sections(df).collect()}
    for size in (1, 5, 1000):
        text = defaultdict(str)
        for r in sorted(templates.section_segments(df, size).collect(), key=lambda r: r.segment):
            assert r.offset == len(text[r.mapping, r.section])
            text[r.mapping, r.section] += r.text
        assert {m: (text[m, "schema"], text[m, "hierarchy"]) for m in ("m", "n")} == whole


def test_nothing_to_order(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert ordered.group_values(df, "k", "v").count() == 0 and ordered.joined_values(df, "k", "v").count() == 0
