import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessella.llm import arrays, suffix_dedup as sd


def brute(rows):
    """(id, bytes, removed, spans, kept) per row; ids are distinct, null last."""
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen[window] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, kept))
    return out


def check(docs, rows):
    got = sd.removed(docs(rows).select("doc_id", "text")).collect()
    found = sorted(((r.rest.doc_id, r.n_bytes, sum(s.e - s.s for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=lambda r: (r[0] is None, r[0] or 0))
    want = brute(rows)
    wrong = [(a[:4], b[:4]) for a, b in zip(found, want) if a != b]
    assert len(found) == len(want) and not wrong, wrong[:5]


def messy(seed, n=60):
    """Documents that share passages of every length around the bound, at any place."""
    pick = random.Random(seed)
    words = [f"{pick.choice('abcdéß')}{pick.randint(0, 999)}" for _ in range(300)]
    text = lambda k: " ".join(pick.choice(words) for _ in range(k))
    shared = [text(pick.choice((14, 17, 19, 20, 21, 25, 60, 200))) for _ in range(12)]
    rows = []
    for doc in range(n):
        parts = [text(pick.randint(0, 30)) for _ in range(4)]
        for _ in range(pick.randint(0, 4)):
            s = pick.choice(shared)
            a = pick.randint(0, len(s) // 3)
            parts.insert(pick.randrange(len(parts)), s[a:] if pick.random() < 0.5 else s[: len(s) - a])
        rows.append((doc * 7 % 101, pick.choice((" ", "\n", "")).join(parts)))
    return rows


def test_given_documents(spark, docs, shared):
    check(docs, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


@pytest.mark.parametrize("group", [1000, 2])
def test_shared_passages(docs, shared, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    check(docs, messy(3) + [(500, "ab" * 400), (501, "x" * 99), (502, "x" * 300), (503, None), (504, ""), (None, "ab" * 120)])


def test_small_sorting_chunks(docs, shared, monkeypatch):
    monkeypatch.setattr(sd, "SORT_ROWS", 3)
    check(docs, messy(5, 40))


def test_repeated_rows(spark, docs, shared):
    text = "one passage that is longer than a hundred bytes, said twice in rows of one id and once in another row, and so on."
    got = sd.removed(docs([(1, text), (1, text), (2, text)]).select("doc_id", "text")).collect()
    assert sorted((r.rest.doc_id, len(r.kept)) for r in got) == [(1, len(text)), (1, len(text)), (2, 0)]
    assert sd.removed(docs([])).collect() == []


def test_columns_are_kept(docs, shared):
    text = "é" * 30 + "".join(f"{k} é " for k in range(60))
    table = docs([(1, text), (2, "ü" + text[40:] + "ß"), (3, None)]).selectExpr("*", "1 as doc", "2 as kept", "'x' as `a.b`")
    out = sd.without_repeats(table)
    assert out.columns == table.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == text and rows[2].text == "üß" and rows[3].text == "" and rows[2].n_chars == 2 and rows[1]["a.b"] == "x"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=6)), max_size=40))
def test_suffix_sort(rows):
    rows = sorted(rows, key=lambda r: r[0])
    group = np.array([g for g, _ in rows], np.int64)
    symbols = np.zeros((len(rows), 6), np.uint16)
    for k, (_, b) in enumerate(rows):
        symbols[k, : len(b)] = np.frombuffer(bytes(x % 3 for x in b), np.uint8).astype(np.uint16) + 1
    order, match = sd.suffix_sort(group, symbols)
    keys = [(int(group[k]), tuple(symbols[k].tolist())) for k in range(len(rows))]
    assert sorted(order.tolist()) == list(range(len(rows)))
    assert [keys[k] for k in order] == sorted(keys)
    for k in range(len(rows)):
        if k == 0 or group[order[k]] != group[order[k - 1]]:
            assert match[k] == -1
        else:
            a, b = symbols[order[k]], symbols[order[k - 1]]
            assert match[k] == next((i for i in range(6) if a[i] != b[i]), 6)


def test_collisions_are_found(monkeypatch):
    monkeypatch.setattr(sd, "prefix_hashes", lambda symbols: np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64))
    symbols = np.array([[3, 1], [2, 2], [2, 1]], np.uint16)
    order, match = sd.suffix_sort(np.zeros(3, np.int64), symbols)
    assert order.tolist() == [2, 1, 0] and match.tolist() == [-1, 1, 0]


def test_surroundings_that_agree_in_32_bits_of_their_hash_are_different(docs, shared):
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    at = int(sd.gram_hashes(letters).argmin())  # of so low a hash that it is the anchor of every window
    n = 300_000
    text = np.tile(rng.integers(97, 123, 2 * sd.SIDE + sd.GRAM).astype(np.uint8), (n, 1))
    text[:, sd.SIDE : sd.LENGTH] = letters[at : at + sd.GRAM]
    for k in range(sd.SIDE):
        if k % 2:
            text[:, [k, k + sd.LENGTH]] = rng.integers(97, 123, (n, 2))
    ends = np.arange(1, n + 1) * text.shape[1]
    around = arrays.mix(arrays.hash_spans(text.ravel(), ends - text.shape[1], ends) + np.uint64(sd.SIDE)) >> np.uint64(32)
    order = np.argsort(around, kind="stable")
    pairs = np.flatnonzero(around[order][1:] == around[order][:-1])
    assert len(pairs)
    check(docs, [(k, text[row].tobytes().decode()) for k, row in enumerate(order[np.concatenate([pairs, pairs + 1])])])


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_whose_hashes_agree_in_31_bits_stay_apart(spark, docs, shared, doc_id):
    rows = spark.range(300_000).selectExpr(f"cast({doc_id if doc_id else 'null'} as long) as doc_id", "concat('text ', id) as text")
    tie = F.shiftrightunsigned(F.xxhash64("text", F.to_json(F.struct("doc_id"))), 33)
    met = rows.groupBy(tie.alias("tie")).agg(F.collect_set("text").alias("texts")).filter("size(texts) > 1").collect()
    texts = sorted(t for r in met for t in r.texts)
    assert texts
    got = sd.removed(docs([(doc_id, t) for t in texts]).select("doc_id", "text")).collect()
    assert sorted(bytes(r.kept).decode() for r in got) == texts


def test_frequent_anchors_make_few_rows(docs, shared, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 50)
    rng = np.random.default_rng(6)
    letters = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    at = int(sd.gram_hashes(letters).argmin())
    gram, passage = letters[at : at + sd.GRAM].tobytes().decode(), "a passage that many rows have after the words that are their anchor, while what is before differs: yes."
    draw = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    rows = [(k, draw(90) + gram + (passage if k % 3 else draw(90))) for k in range(300)]
    made = []
    monkeypatch.setattr(sd, "written", lambda df, label, held=sd.written: made.append((label, out := held(df, label))) or out)
    check(docs, rows)
    assert 0 < sum(df.count() for label, df in made if label == "halves") < 20 * len(rows)
