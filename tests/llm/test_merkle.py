import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle
from tessella.llm.queries import crc32_sql
from tessella.llm.registry import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([H(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def path(rows, i):
    out = []
    for row in rows[:-1]:
        j = i ^ 1
        out.append(("-", "") if j >= len(row) else ("L" if j < i else "R", row[j]))
        i //= 2
    return out


def fold(h, beside):
    for side, d in beside:
        h = H(d, h) if side == "L" else H(h, d) if side == "R" else H(h)
    return h


def brute(rows):
    """Rows of (doc_id, grp, leaf, changed) with their proofs, by whole trees."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    trees = [levels_of([r[2] for r in g]) for g in groups.values()]
    top = levels_of([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, (g, tree) in enumerate(zip(groups.values(), trees)):
        for i, (doc, _, leaf, changed) in enumerate(g):
            beside = path(tree, i) + path(top, k)
            assert fold(leaf, beside) == top[-1][0]
            out.append((doc, leaf, tree[-1][0], top[-1][0], "".join(d for _, d in beside), "".join(s for s, _ in beside), fold(changed or leaf, beside)))
    return sorted(out, key=repr)


def table(spark, rows):
    made = [(d, g, bytes.fromhex(a), bytes.fromhex(b) if b else None) for d, g, a, b in rows]
    return spark.createDataFrame(made, "doc_id bigint, grp string, leaf binary, changed binary")


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels, chunk", [(2, 3), (merkle.LEVELS, merkle.CHUNK)])
def test_manifest_matches_whole_trees(spark, levels, chunk):
    random.seed(3)
    sizes = {None: 3, "": 1, "a": 70, "b": 9, "é": 8, "Z": 17, "zz": 2}
    rows = [(random.choice([None, *range(30)]), g, H(g or "?", str(i // 2)), H("x", str(i)) if i % 3 == 0 else None) for g, n in sizes.items() for i in range(n)]
    random.shuffle(rows)
    rows.append((4, "same", H("s"), None))
    rows.append((4, "same", H("s"), H("t")))  # rows that only differ in what changed keep the order read
    got = merkle.manifest(table(spark, rows).coalesce(1), levels, chunk)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "sides", "folded_root"]
    steady = [r for r in rows if r[1] != "same"]
    a, b = told(got), brute(rows)
    order = lambda r: (r[0] is None, r[0], r[1], r[4], r[5])
    assert [r[:6] for r in sorted(a, key=order)] == [r[:6] for r in sorted(b, key=order)]
    only = merkle.manifest(table(spark, [r for k, r in enumerate(steady) if r[2] not in {q[2] for q in steady[:k]}]), levels, chunk)
    assert told(only) == brute([r for k, r in enumerate(steady) if r[2] not in {q[2] for q in steady[:k]}])


def test_proofs_lead_to_the_root(spark):
    rows = [(i, "ab"[i % 7 == 0], H(str(i)), None) for i in range(41)]
    got = merkle.manifest(table(spark, rows), 2, 3).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"), F.col("sides")))
    assert got.filter("again <> root or folded_root <> root").count() == 0 and got.count() == 41


def test_store_shares_what_a_version_leaves_alone():
    leaves = [H(str(i)) for i in range(11)]
    store = merkle.Store(leaves, 4)
    before, size = list(store.digest), len(store.digest)
    root = store.changed(6, H("new"))
    assert store.digest[:size] == before and len(store.digest) == size + 1 + 4
    assert store.digest[root] == levels_of([*leaves[:6], H("new"), *leaves[7:]])[-1][0]
    shared = {n for at in range(size, len(store.digest)) for n in (store.left[at], store.right[at]) if 0 <= n < size}
    assert len(shared) == 4
    store.forget()
    assert store.digest == before and store.digest[store.root] == levels_of(leaves)[-1][0]


def test_encoding(spark):
    row = spark.createDataFrame([(None, "é\n", "", -3)], "a bigint, b string, c string, d bigint")
    got = row.select(F.lower(F.hex(merkle.leaf(*(F.col(c) for c in "abcd"))))).first()[0]
    assert got == H("-3:é\n0:2:-3")


def test_edge_cases(spark, docs):
    assert merkle.manifest(table(spark, [])).count() == 0
    one = [(None, None, H("a"), H("b"))]
    assert told(merkle.manifest(table(spark, one))) == [(None, H("a"), H("a"), H("a"), "", "", H("b"))]
    same = [(1, "g", H("a"), None)] * 5
    assert told(merkle.manifest(table(spark, same), 1, 1)) == brute(same)


def test_crc32_of_the_sql():
    import duckdb

    for n in (0, 7, 49, 123_456_789_012, -5):
        assert duckdb.sql(f"select {crc32_sql(f'({n})')}").fetchall()[0][0] == zlib.crc32(str(n).encode())


def test_query_on_rows_with_nulls_and_long_texts(spark, shared):
    rows = [(i, None if i % 5 == 0 else "t" * (i * 1000), [None, "en", ""][i % 3], None if i % 4 else "s", None if i % 6 == 0 else i) for i in range(60)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("grp", F.lit(1)).withColumn("row", F.lit("x"))
    data.write.parquet(f"{shared}/documents.parquet")
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: H("".join(enc(v) for v in (i, s, g, n, t)))
    want = brute([(r[0], r[2], leaf(*r), leaf(*r[:4], r[4] + 1 if r[4] is not None else None) if zlib.crc32(str(r[0]).encode()) % 7 == 0 else None) for r in rows])
    got = QUERIES["op11_merkle_manifest"](spark, shared).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(
        (d, a, s, r, H(p), f, f == r) for d, a, s, r, p, _, f in want
    )
    assert {r.verified for r in got} == {True, False}
