import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm import fingerprints as fp, sharding


def brute_fill(weights, slots):
    orders = []
    for name in weights:
        d = hashlib.md5(name.encode()).hexdigest()
        start, skip = int(d[:16], 16) % slots, int(d[16:], 16) % (slots - 1) + 1
        orders.append(iter([(start + j * skip) % slots for j in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for shard, weight in enumerate(weights.values()):
            for _ in range(weight):
                slot = next((s for s in orders[shard] if s not in owner), None)
                if slot is not None:
                    owner[slot] = shard
    return [owner[s] for s in range(slots)]


def test_fill_matches_brute_force_and_is_balanced():
    for n, slots in ((1, 7), (3, 101), (10, 997)):
        weights = {f"s{k}": 1 + k % 2 for k in range(n)}
        assert sharding.fill(weights, slots) == brute_fill(weights, slots)
    held = Counter(sharding.fill({f"s{k}": 1 for k in range(64)}))
    assert max(held.values()) - min(held.values()) <= 1


def test_removing_a_shard_moves_little():
    weights = {f"s{k}": 1 for k in range(64)}
    a, b = sharding.fill(weights), sharding.fill(dict(list(weights.items())[:-1]))
    assert sum(x != y for x, y in zip(a, b)) < 0.06 * len(a)


def test_place_keeps_rows(spark, docs):
    table = docs([(None, None), (1, "a"), (1, "a"), (2, "")]).selectExpr("*", "1 as slot", "2 as owner")
    out = sharding.place(table, "doc_id", {"x": 1, "y": 1})
    assert out.columns == [*table.columns, "shard"] and out.count() == 4
    assert len({r.shard for r in out.collect() if r.doc_id == 1}) == 1
    assert sharding.place(docs([]), "doc_id", {"x": 1}).count() == 0
    hot = spark.range(2000).selectExpr("7 as k", "id")
    assert len({r.shard for r in sharding.place(hot, "k", {f"s{i}": 1 for i in range(8)}, spread=64).collect()}) > 4


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def sketches(spark, docs, texts):
    rows = fp.sketch(docs(list(enumerate(texts)))).collect()
    return [r.sketch for r in sorted(rows, key=lambda r: r.doc_id)]


def test_estimates(spark, docs):
    pick = random.Random(3)
    base = [f"w{pick.randint(0, 10**6)}" for _ in range(4000)]
    texts = [" ".join(base), " ".join(base[:2000]), " ".join(base[:3000] + [f"x{k}" for k in range(1000)]), "a b c d e f", "a b c", "", None]
    found = sketches(spark, docs, texts)
    assert [len(s) for s in found] == [128, 128, 128, 2, 1, 0, 0]
    pairs = spark.createDataFrame([(i, j, found[i], found[j]) for i in range(7) for j in range(7)], "i int, j int, a array<bigint>, b array<bigint>")
    out = pairs.select("i", "j", fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_shingles(F.col("a")).alias("n")).collect()
    for r in out:
        a, b = shingles(texts[r.i]), shingles(texts[r.j])
        assert abs(r.r - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        assert abs(r.c - (len(a & b) / len(a) if a else 1)) < 0.25
        assert abs(r.n - len(a)) <= 0.25 * len(a)


def test_merge_equals_the_whole(spark, docs):
    words = [f"w{k * 7919 % 10007}" for k in range(3000)]
    parts = [" ".join(words[i : i + 104]) for i in range(0, 2900, 100)]
    sets = set().union(*map(shingles, parts))
    rows = fp.sketch(docs([(k, p) for k, p in enumerate(parts)])).selectExpr("'all' as part", "sketch")
    merged = fp.merge(rows, "part").first().sketch
    every = sorted({h for r in rows.collect() for h in r.sketch})
    assert merged == every[:128] and len(sets) > 2000


def test_next_document_wraps_and_ties(spark, docs, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 3)
    rows = [(k * k % 101, f"t{k} word") for k in range(40)] + [(None, "null id"), (5, None), (5, "five"), (5, "five")]
    got = fp.with_next(docs(rows).selectExpr("*", "1 as bucket", "2 as ghost", "3 as sketch")).collect()
    order = sorted(((i if i is not None else -1, t or "") for i, t in rows), reverse=True)
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text, r.next_text) for r in got) == want


def test_one_document_is_its_own_next(docs):
    r = fp.with_next(docs([(1, "a b")])).first()
    assert r.next_text == "a b" and fp.with_next(docs([])).collect() == []


def test_edited_text(spark):
    cases = [("abcde", "xyz"), ("é😀ßà", "q"), ("", "abc"), ("a", "b"), ("abcd", "")]
    out = spark.createDataFrame(cases, "a string, b string").select("a", "b", fp.edited(F.col("a"), F.col("b")).alias("e")).collect()
    for r in out:
        half = len(r.a) // 2
        assert r.e == r.a[: len(r.a) - half] + r.b[:half]
