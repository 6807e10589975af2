"""Clustered stores, stars of many values, reduced paths, interval joins and division."""

import random
import re
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as g
from tessella.sources import clustered

SCHEMA = "s string, p string, o string, o_kind string, dtype string, lang string"


def triples(spark, rows):
    return spark.createDataFrame([(s, p, o, "iri", None, None) for s, p, o in rows], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def shop(n):
    rows = [(f"o{i}", g.TYPE, "Order") for i in range(n)] + [(f"o{i}", "by", f"c{i % 50}") for i in range(n)]
    rows += [(f"o{i}", "status", "FOP"[i % 3]) for i in range(n)] + [(f"c{i}", "in", f"n{i % 5}") for i in range(50)]
    return rows


def test_star_over_a_store_moves_nothing(spark, no_broadcast):
    t = triples(spark, shop(3000))
    store = clustered.write_clustered(t, f"t_{uuid.uuid4().hex[:8]}", 8)
    assert store.heavy is None
    star = lambda part: g.star(g.instances(part, "Order", "x"), part, "x", {"by": "c", "status": "s"})
    df = store.each(star)
    assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
    assert same(df, star(t)) and df.count() == 3000
    hops = [("by", "c"), ("in", "n")]
    way = g.path(g.instances(store, "Order", "x"), store, "x", hops)
    assert plan(way).count("Exchange hashpartitioning") == 1  # what has been found moves to the next subject, the store doesn't
    assert same(way, g.path(g.instances(t, "Order", "x"), t, "x", hops))


def test_constant_subject_reads_one_bucket(spark):
    store = clustered.write_clustered(triples(spark, shop(3000)), f"t_{uuid.uuid4().hex[:8]}", 8)
    df = g.pattern(store, "by", None, "c", subject="o77")
    assert [r.c for r in df.collect()] == ["c27"]
    assert "EqualTo(s,o77)" in plan(df)
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 28)  # a task for each file
    try:
        one, all_ = g.pattern(store, "by", None, "c", subject="o78"), g.pattern(store, "by", None, "c")
        assert (one.rdd.getNumPartitions(), all_.rdd.getNumPartitions()) == (1, 8)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)


def test_row_groups_are_sorted_by_subject(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    held = clustered.ROW_GROUP
    clustered.ROW_GROUP = 4096
    try:
        name = f"t_{uuid.uuid4().hex[:8]}"
        clustered.write_clustered(triples(spark, [(f"subject {i:07d}", "p", f"{i}") for i in range(60_000)]), name, 2)
    finally:
        clustered.ROW_GROUP = held
    location = spark.sql(f"describe formatted {name}").filter("col_name = 'Location'").first()["data_type"].removeprefix("file:")
    files = glob.glob(f"{location}/p=p/*.parquet")
    assert len(files) == 2
    for path in files:
        meta = pq.ParquetFile(path).metadata
        bounds = [meta.row_group(k).column(0).statistics for k in range(meta.num_row_groups)]
        assert all(a.max <= b.min for a, b in zip(bounds, bounds[1:]))


def test_heavy_subjects_are_kept_apart(spark):
    rows = shop(300) + [("hot", "by", f"c{i % 50}") for i in range(900)] + [("hot", g.TYPE, "Order"), ("hot", "status", "F")]
    t = triples(spark, rows)
    store = clustered.write_clustered(t, f"t_{uuid.uuid4().hex[:8]}", 8)
    assert [r.s for r in clustered.heavy_subjects(t, 8).collect()] == ["hot"]
    assert store.heavy is not None and store.light.all().filter("s = 'hot'").count() == 0
    assert same(store.all().select("s", "p", "o"), t.select("s", "p", "o"))
    star = lambda part: g.star(g.instances(part, "Order", "x"), part, "x", {"by": "c", "status": "s"})
    assert same(store.each(star), star(t)) and store.each(star).filter("x = 'hot'").count() == 900


@pytest.mark.parametrize("most", [g.MOST_VALUES, 20])
def test_star_of_many_values_is_the_star(spark, most):
    random.seed(1)
    rows = [(f"s{i}", p, f"{p}{random.randrange(4)}") for i in range(80) for p in "abc" for _ in range(random.randrange(4))]
    rows += [("hot", "a", f"{k}") for k in range(300)] + [("hot", "b", f"{k % 3}") for k in range(7)] + [("hot", "c", "x")]
    rows += [("hot2", "b", f"{k}") for k in range(100)] + [("hot2", "a", "x")] + [("other", "z", "1")]
    t = triples(spark, rows)
    wanted = {"a": "va", "b": "vb", "c": "vc"}
    found = g.star_once(t, "x", wanted, most)
    plain = g.star(g.pattern(t, "a", "x", None).distinct(), t, "x", wanted)
    assert found.columns == ["x", "va", "vb", "vc"] and same(found, plain) and found.filter("x = 'hot'").count() == 2100
    assert g.star_once(t, "x", {"a": "va", "none": "vn"}, most).count() == 0


def test_star_of_many_values_moves_rows_once(spark):
    t = triples(spark, shop(500))
    text = plan(g.star_once(t, "x", {"by": "c", "status": "s"}))
    assert len(re.findall(r"Exchange hashpartitioning\(x#\d+, __block#", text)) == 1
    # All others carry subjects that the sketch has named, of which there are none here.
    others = [line for line in text.splitlines() if "Exchange" in line and not re.search(r"__block#|SinglePartition|BroadcastExchange", line)]
    assert all("__blocks#" in line for line in others)


def chain(n):
    rows = []
    for i in range(n):
        rows += [(f"a{i}", "p", f"b{i // 2}"), (f"a{i}", "p", f"b{i % 7}"), (f"b{i}", "q", f"c{i // 3}"), (f"c{i}", "r", f"d{i % 11}"), (f"d{i}", "u", f"e{i % 5}"), (f"e{i}", "v", f"f{i}")]
    return rows


def test_reduced_path_is_the_path(spark):
    t = triples(spark, chain(120))
    hops = [("p", "b"), ("q", "c"), ("r", "d"), ("u", "e"), ("v", "f")]
    starts = g.pattern(t, "p", "a", None).distinct().filter("a < 'a5'").withColumn("kept", F.lit(1))
    where = {"f": F.col("f") == "f3", "c": F.col("c") != "c2"}
    want = g.path(starts, t, "a", hops).filter(where["f"] & where["c"])
    assert same(g.reduced_path(starts, t, "a", hops, where), want) and want.count() > 10
    assert same(g.reduced_path(starts, t, "a", hops), g.path(starts, t, "a", hops))
    assert g.reduced_path(starts, t, "a", hops, {"f": F.col("f") == "none"}).count() == 0


def test_only_what_reaches_the_end_is_kept(spark, monkeypatch):
    kept = {}
    plain = g.written
    monkeypatch.setattr(g, "written", lambda df, label: kept.setdefault(label, plain(df, label)))
    rows = [(f"o{i}", "by", f"c{i % 400}") for i in range(2000)] + [(f"c{i}", "in", f"n{i % 40}") for i in range(400)] + [(f"n{i}", "label", f"L{i}") for i in range(40)]
    t = triples(spark, rows)
    some = g.pattern(t, "by", "o", None).filter("o < 'o12'")
    found = g.reduced_path(some, t, "o", [("by", "c"), ("in", "n"), ("label", "l")], {"l": F.col("l") == "L3"})
    ends = [i for i in range(2000) if f"o{i}" < "o12" and i % 40 == 3]
    assert sorted(r.o for r in found.collect()) == sorted(f"o{i}" for i in ends)
    customers = len({i % 400 for i in ends})
    assert {label: df.count() for label, df in kept.items()} == {
        "back-2": 1, "back-1": 10, "back-0": 50, "forth-0": len(ends), "forth-1": customers, "forth-2": 1,
    }


def test_interval_join_matches_brute_force(spark):
    random.seed(2)
    bounds = [(f"i{k}", lo := random.randrange(-3000, 3000), lo + random.choice([-1, 0, 1, 7, 64, 1000, 5000])) for k in range(2000)]
    bounds += [("all", -(2**62), 2**62), ("none", None, 5), ("open", 5, None), ("same", 4, 4), ("same", 4, 4)]
    values = [(k, random.randrange(-4000, 9000)) for k in range(300)] + [(300, None), (301, 4), (302, 4), (303, 2**61), (304, -(2**61))]
    table = spark.createDataFrame(bounds, "name string, low bigint, high bigint")
    df = spark.createDataFrame(values, "id bigint, v bigint")
    found = g.interval_join(df, "v", table, "low", "high")
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text
    want = sorted((i, n) for i, v in values if v is not None for n, lo, hi in bounds if lo is not None and hi is not None and lo <= v <= hi)
    assert sorted((r.id, r.name) for r in found.collect()) == want
    outer = g.interval_join(df, "v", table.filter("name not in ('all')"), "low", "high", "left")
    some = {i for i, n in want if n != "all"}
    assert {r.id for r in outer.filter("name is null").collect()} == {i for i, _ in values} - some
    assert g.interval_join(df, "v", table.filter("false"), "low", "high").count() == 0
    assert g.interval_join(df, "v", table.filter("false"), "low", "high", "left").count() == len(values)


def test_pieces_cover_an_interval_once(spark):
    cases = [(a, b) for a in range(-9, 10) for b in range(a - 1, 12)] + [(0, 2**40), (-(2**40) + 1, 2**33 + 5)]
    rows = spark.createDataFrame(cases, "a bigint, b bigint").select("a", "b", g.pieces_of(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        spans = sorted((c.piece << c.level, (c.piece + 1) << c.level) for c in r.c)
        assert len(r.c) <= 2 * max(1, (r.b - r.a + 1).bit_length())
        assert not spans if r.a > r.b else spans[0][0] == r.a and spans[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_division_matches_brute_force(spark):
    random.seed(3)
    has = [(f"s{random.randrange(12)}", random.choice("abcd")) for _ in range(90)] + [("s1", None), (None, "a"), ("s2", "a")]
    asked = [(grp, v) for grp, vs in (("g1", "ab"), ("g2", "abcd"), ("g3", "a"), ("g4", "x"), (None, "bd"), ("g5", "aab")) for v in vs] + [("g6", None), ("g6", "a")]
    rows = spark.createDataFrame(has, "s string, v string")
    got = g.divided(rows, spark.createDataFrame(asked, "grp string, v string"), "s", "v", "grp").collect()
    values, groups = defaultdict(set), defaultdict(set)
    for s, v in has:
        values[s].add(v)
    for grp, v in asked:
        groups[grp].add(v)
    want = {(grp, s) for grp, vs in groups.items() for s, own in values.items() if None not in vs and vs <= own}
    assert {(r.grp, r.s) for r in got} == want and len(got) == len(want)
    whole = lambda vs: {r.s for r in g.divided(rows, spark.createDataFrame([(v,) for v in vs], "v string"), "s", "v").collect()}
    assert whole("ab") == {s for s, own in values.items() if {"a", "b"} <= own}
    assert whole("") == set(values) and whole("x") == set() and whole(["a", None]) == set()


def test_subjects_of_many_values_are_divided_by_themselves(spark):
    rows = spark.createDataFrame([(f"s{i % 3}", f"v{i}") for i in range(60)] + [("few", "v0"), ("few", "v3"), ("few", "v3")], "s string, v string")
    asked = spark.createDataFrame([("a", f"v{i}") for i in range(0, 60, 3)] + [("b", "v0"), ("b", "v3"), ("c", "v1")], "grp string, v string")
    for most in (3, 10_000):
        got = g.divided(rows, asked, "s", "v", "grp", most).collect()
        assert sorted((r.grp, r.s) for r in got) == [("a", "s0"), ("b", "few"), ("b", "s0"), ("c", "s1")]


def test_division_counts_sets_of_values_not_subjects(spark):
    """Subjects meet the groups as the sets of values that occur: here two, for a thousand subjects."""
    rows = spark.range(2000).selectExpr("'s' || id % 1000 as s", "'v' || if(id < 1000, 0, id % 2) as v")
    asked = spark.range(100).selectExpr("'g' || id % 50 as grp", "'v' || id % 2 as v").distinct()
    df = g.divided(rows, asked, "s", "v", "grp")
    assert df.count() == 50 // 2 * 1000 + 50 // 2 * 500
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan


def test_group_texts_hold_no_table_of_groups_and_values(spark):
    rows = [("a", "y", 2), ("a", "x", 2), ("a", "x", None), ("b", None, None), (None, "z", 1)]
    df = spark.createDataFrame(rows, "k string, v string, w int")
    one, two = g.group_concat(df, "k", "v", "t"), g.group_concats(df, "k", {"v": "t", "w": "u"}, "|")
    assert {tuple(r) for r in one.collect()} == {("a", "x, y"), ("b", ""), (None, "z")}
    assert {tuple(r) for r in two.collect()} == {("a", "x|y", "2"), ("b", "", ""), (None, "z", "1")}
    for made in (one, two):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
