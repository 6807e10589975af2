import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import list_ranking, prefix_trie
from tessella.llm.queries import rebuilt
from tessella.llm.registry import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(turns)] for c, turns in convs.items()}


def redone(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    inner = {key[:-1] for key in members if key}
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = sum(k not in inner for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        children = sum(len(k) == len(key) + 1 for k in below)
        text = ",".join(map(str, sorted(ends[key])))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(own), len(key), parent, len(own), children, leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def told(found):
    rows = found.nodes.join(prefix_trie.id_digests(found.ends), "id", "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    return sorted((*(r[c] for c in NAMES), r.sha256 or none) for r in rows)


def chats(n, seed, branch=2):
    random.seed(seed)
    return [(c, t, random.choice(["user", None, ""]), random.choice(["é", "hello", None, ""][:branch])) for c in range(n) for t in range(random.choice([0, 1, 3, 6, 12]))]


@pytest.mark.parametrize("base", [list_ranking.BASE, 4])
def test_trie_matches_brute_force(spark, base, monkeypatch):
    rows = chats(60, 1) + [(61, None, "user", "first"), (61, 2, "a", "b"), (61, 2, "a", "b"), (61, 2, "a", "a"), (None, 1, "x", "y"), (65, 0, "q", "w" * 200_000)]
    random.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("z").alias("id"), F.lit(1).alias("depth"), F.lit(2).alias("row"))
    ordinary = prefix_trie.turns(table)
    found = prefix_trie.trie(ordinary.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "bytes"), ordinary.select("conv_id").distinct(), base)
    assert told(found) == brute(ordered(rows))


def test_rebuilt_conversations_match_brute_force(spark, shared):
    rows = chats(97, 2, 4) + [(c, 0, "user", "one") for c in (200, 203, 211, 1000)]
    spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(1)).write.parquet(f"{shared}/conversations.parquet")
    got = QUERIES["op12_prefix_trie"](spark, shared)
    assert got.columns == [*NAMES, "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute(redone(ordered(rows)))


def test_many_alike_many_children_and_long_ones(spark):
    alike = [(c, t, "u", f"same {t}") for c in range(300) for t in range(3)]
    fan = [(1000 + c, t, "u", "first" if t == 0 else f"own {c}") for c in range(300) for t in range(2)]
    long = [(c, t, "u", str(t % 7)) for c in (5000, 5001) for t in range(2600 if c == 5000 else 2100)]
    found = prefix_trie.of(spark.createDataFrame(alike + fan + long, SCHEMA)).nodes.collect()
    by = {(r.conv_id, r.depth): r for r in found}
    assert len(found) == 1 + 3 + 1 + 300 + 2600
    root = by[0, 0]
    assert (root.n_convs, root.n_children, root.n_leaves) == (602, 3, 302)
    assert root.saved_tokens == 299 * 18 + 299 * 5 + 2100
    assert by[1000, 1].n_children == 300 and by[5000, 2100].n_convs == 2 and by[5000, 2101].n_convs == 1
    assert by[5000, 2599].saved_tokens == 0 and by[5000, 1].n_leaves == 1


@pytest.mark.parametrize("base", [list_ranking.BASE, 3])
def test_list_ranking(spark, base):
    random.seed(4)
    ids = random.sample(range(10**12), 120)
    elements = [(x, ids[k - 1] if k % 40 else None, random.randrange(5)) for k, x in enumerate(ids)]  # three lists
    upto, total = {}, 0
    for k, (x, _, size) in enumerate(elements):
        total = size + (total if k % 40 else 0)
        upto[x] = total
    random.shuffle(elements)
    got = list_ranking.ranked(spark.createDataFrame(elements, "id bigint, before bigint, size bigint"), base)
    assert {r.id: r.upto for r in got.collect()} == upto and got.count() == len(upto)


def test_ids_are_joined_over_strings(spark):
    ends = spark.createDataFrame([(k, c) for k in (7, 8) for c in range(9000 if k == 7 else 1)] + [(9, -3), (9, 12), (9, 5)], "id bigint, conv_id bigint")
    text = {7: ",".join(map(str, range(9000))), 8: "0", 9: "-3,5,12"}
    got = {r.id: r.sha256 for r in prefix_trie.id_digests(ends).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in text.items()}


def test_no_conversations(spark):
    found = prefix_trie.of(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))
    assert found.nodes.count() == 0 and found.ends.count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    turns = prefix_trie.turns(spark.createDataFrame([(c, 0, "u", "t") for c in (1, 2, 3, 4, 6)], SCHEMA))
    rows, convs = rebuilt(turns)
    own = {c: [("u", "t")] for c in (1, 2, 3, 4, 6)}
    assert told(prefix_trie.trie(rows, convs)) == brute(redone(own))
