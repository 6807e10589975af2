import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tessella.llm import exact_dedup
from tessella.llm.registry import documents


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    same = defaultdict(list)
    for i, t in rows:
        same[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        group = same[plain(t)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


ROWS = [
    (5, "a b"), (3, "ab"), (4, "a\tb"), (9, "a  b"), (None, "ab "), (7, None), (8, ""), (2, " \n\x0b"), (None, None), (1, "ä b"), (6, "äb"),
    (10, "x" * 300_000), (11, "x" * 150_000 + " " + "x" * 150_000), (12, "a b"), (13, "A B"), (14, "c"), (14, "c"), (14, "d c"), (15, "dc"),
]


@pytest.mark.parametrize("counters, bits", [(exact_dedup.COUNTERS, exact_dedup.BLOCK_BITS), (2, 1), (1, 0)])
def test_groups_match_brute_force(docs, counters, bits):
    rows = exact_dedup.groups(docs(ROWS), counters=counters, block_bits=bits)
    assert rows.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert told(rows) == brute(ROWS)
    stay = Counter(r.text_sha256 for r in rows.filter("kept").collect())
    assert set(stay.values()) == {1} and len(stay) == len({plain(t) for _, t in ROWS})


def test_a_third_in_one_group_and_another_in_pairs(spark, docs):
    random.seed(5)
    rows = [(i, "hot" + " " * (i % 7)) for i in range(1000)] + [(1000 + i, f"pair {i // 2}") for i in range(1000)] + [(2000 + i, f"own {i}") for i in range(1000)]
    random.shuffle(rows)
    table = docs(rows).repartition(7)
    assert told(exact_dedup.groups(table, counters=16, block_bits=5)) == brute(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 12).map(lambda x: x * x // 12), min_size=1, max_size=200), st.integers(1, 6), st.integers(0, 5))
def test_counters_hold_every_frequent_digest(spark, values, counters, bits):
    marks = spark.createDataFrame([(i, bytes([v])) for i, v in enumerate(values)], "row bigint, digest binary")
    found = {r.digest[0] for r in exact_dedup.frequent(marks, counters, bits).collect()}
    assert len(found) <= counters
    assert {v for v, n in Counter(values).items() if n * (counters + 1) > len(values)} <= found


def test_frequent_texts_are_decided_without_a_shuffle(spark, docs):
    table = docs([(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    marks = exact_dedup.written(exact_dedup._numbered(table, "doc_id", "text"), "marks")
    found = [bytes(r.digest) for r in exact_dedup.frequent(marks, 8, 6).collect()]
    assert hashlib.sha256(b"hot").digest() in found


def test_keep_returns_whole_rows_of_any_names(docs):
    table = docs(ROWS).select("*", F.lit(1).alias("row"), F.lit("x").alias("best"), F.lit(2).alias("digest"), F.lit(None).cast("string").alias("kept"), F.create_map(F.lit("k"), F.lit(1)).alias("doc"))
    stay = exact_dedup.keep(table)
    assert stay.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr)
    assert len(got) == len({plain(t) for _, t in ROWS})
    assert {(9, "a  b"), (14, "d c"), (1, "ä b"), (11, ROWS[12][1])} <= set(got)


def test_empty_tables(docs):
    assert exact_dedup.groups(docs([])).count() == 0
    assert exact_dedup.keep(docs([])).count() == 0


def test_given_documents_match_brute_force(spark):
    table = documents(spark, "/root/testdata/sf0.001")
    assert told(exact_dedup.groups(table)) == brute([(r.doc_id, r.text) for r in table.collect()])
