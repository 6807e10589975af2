import random
import re

import numpy as np
import pytest

from tessella.llm import near_duplicates as nd
from tessella.llm.components import components


def sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, size, percent):
    """Component of each row; rows are (id, text) with distinct ids."""
    own = [sets(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = own[i], own[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: (len(own[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def check(docs, rows, size=2, percent=80):
    got = nd.near_duplicates(docs(rows), size, percent).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows)
    wrong = [(r, want[r.doc_id]) for r in got if (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert not wrong, wrong[:3]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_given_documents(spark, docs, shared):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(docs, rows)
    check(docs, rows, 5)


def test_groups_larger_than_a_small_node(spark, docs, shared, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 6)
    pick = random.Random(8)
    rows = []
    for group in range(6):
        base = [f"w{pick.randint(0, 4000)}" for _ in range(120)]
        for _ in range((3, 40, 90, 8, 1, 15)[group]):
            words = list(base)
            for _ in range(pick.randint(0, 7)):
                words[pick.randrange(len(words))] = f"x{pick.randint(0, 10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rows += [(1000 + k, f"the of and in {k % 7} alone{k} word{k * k}") for k in range(60)]
    pick.shuffle(rows)
    check(docs, rows)


def test_odd_rows(docs, shared):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "two words"), (7, "TWO words"), (8, "É b c"), (9, "é b c"), (10, "z" * 50_000)]
    check(docs, rows)
    table = docs([(None, "same text here"), (3, "same text here"), (None, "none of it"), (None, None), (3, "same text here")])
    got = nd.near_duplicates(table.selectExpr("*", "1 as node", "2 as cls", "3 as n"), 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True)]
    assert nd.near_duplicates(docs([]), 2).collect() == []


def test_missed_pairs_shrink_with_trees():
    assert nd.missed(0.8, 0) == 0 and abs(nd.missed(0.8, 1) - (0.75 * 0.2 + 0.25 * 0.04)) < 1e-12
    assert nd.missed(0.8, 4) ** 12 < nd.MISS


@pytest.mark.parametrize("links,want", [
    ([(2, 1), (3, 2), (4, 3), (5, 4), (9, 8)], {2: 1, 3: 1, 4: 1, 5: 1, 9: 8}),
    ([(1, 2), (1, 2), (7, 1), (5, 5)], {2: 1, 7: 1}),
    ([], {}),
])
def test_components(spark, shared, links, want):
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == want


def test_pairs_at_the_bound_are_found_below_large_nodes():
    depth, pairs, trees = 5, 400, nd.trees_for(0.8, 5)
    assert nd.missed_by(trees, 0.8, depth) <= nd.MISS < nd.missed_by(trees - 1, 0.8, depth)
    rng = np.random.default_rng(6)
    one, other = rng.integers(0, 1 << 16, (2, pairs, nd.POSITIONS)).astype(np.uint16)
    signature = np.concatenate([one, np.where(rng.random(one.shape) < 0.8, one, other)])
    found = np.zeros(pairs, bool)
    for tree in range(trees):
        row, node = np.arange(2 * pairs), np.full(2 * pairs, tree + 1)
        for _ in range(depth):
            moved, node = nd.branch(node, signature[row])
            row = row[moved]
        for _ in range(3):
            moved, node = nd.subtrees(node, signature[row], nd.copies_of(0.8))
            row = row[moved]
        left, right = (set(zip((row[k] % pairs).tolist(), node[k].tolist())) for k in (row < pairs, row >= pairs))
        found[[k for k, _ in left & right]] = True
    assert found.all()


def test_close_pairs_in_a_large_family_of_unlike_texts(docs, shared):
    pick = random.Random(5)
    shared_words = [f"s{k}" for k in range(100)]
    rows = []
    for k in range(200):
        words = shared_words + [f"u{k}_{i}" for i in range(100)]
        near = words[:-22] + [f"v{k}_{i}" for i in range(22)]  # 177 of 221 pairs of words in common
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    pick.shuffle(rows)
    check(docs, rows)


def near_copies(pick, rows, edits):
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(rows):
        words = list(base)
        for k in pick.sample(range(120), edits):
            words[k] = f"x{pick.randint(0, 10**6)}"
        texts.append(" ".join(words))
    return texts


def test_a_group_of_copies_below_the_bound_makes_fewer_rows_than_it_has(docs, shared):
    texts = near_copies(random.Random(2), 300, 9)
    table = docs(list(enumerate(texts)))
    described = nd._described(table, 2).withColumnRenamed("doc_id", "cls")
    crowded = described.selectExpr("1L as node", "cls", "cls as component", "300L as size", "0L as top", "299L as others", "n", *nd.SKETCH)
    assert 0 < nd._like(crowded, 0.8, False).count() < 300
    close = [sets(t, 2) for t in texts]
    assert sum(len(a & b) >= 0.55 * len(a | b) for i, a in enumerate(close) for b in close[:i]) > 20_000


def test_families_of_several_blocks(docs, shared, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "NODE_ROWS", 16)
    pick = random.Random(4)
    texts = near_copies(pick, 60, 9) + near_copies(pick, 50, 5) + near_copies(pick, 30, 2)
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    pick.shuffle(rows)
    check(docs, rows)


def test_common_sizes_of_sets():
    rng = np.random.default_rng(3)
    for rows, words in ((5, 40), (90, 300), (90, 20)):
        own = [np.unique(rng.integers(0, words, 30)).astype(np.uint64) for _ in range(rows)]
        got = nd.common_sizes(np.concatenate(own), np.repeat(np.arange(rows), [len(x) for x in own]), rows)
        want = [[len(np.intersect1d(a, b)) for b in own] for a in own]
        assert np.array_equal(np.triu(got, 1), np.triu(want, 1))
