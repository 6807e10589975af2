import collections
import re

from tessella.llm import quality_rules as rules

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b c d e a b c d e"), (4, "a b c d e a b c d e"), (None, "x\n x\nx\n\nx y"),
    (5, "é#ü $$ <tag> " * 40), (6, "one two three four five six seven eight nine ten eleven"), (7, "w" * 200_000 + " z" * 50_000),
    (8, "\n".join(["same line of words here"] * 9)), (9, "LOUD WORDS " * 30),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measurements_match_brute_force(docs):
    got = rules.ledger(docs(ODD)).collect()
    fields = rules.MEASURES[:5]
    want = sorted(((i or 0, *brute(t)) for i, t in ODD))
    assert sorted((r.doc_id or 0, *(r[f] for f in fields)) for r in got) == want


def test_bits_and_policies(spark, docs):
    rows = {r.doc_id: r for r in rules.ledger(docs(ODD)).select("*", rules.passes("base").alias("ok")).collect()}
    assert rows[1].failed & rules.BITS["few_words"] and not rows[1].ok
    assert rows[6].failed == 0 and rows[6].ok
    assert rows[8].failed & rules.BITS["repeated_lines"] and rows[9].failed & rules.BITS["shouting"]


def test_keep_returns_the_rows_unchanged(spark, docs):
    table = docs(ODD).selectExpr("*", "1 as n_words", "'x' as key", "2 as failed", "3 as `a.b`")
    kept = rules.keep(table, "base")
    assert kept.schema == table.schema
    assert [r.doc_id for r in kept.collect()] == [6]


def test_empty_table(docs):
    assert rules.ledger(docs([])).collect() == [] and rules.keep(docs([])).collect() == []


def test_ablation_agrees_with_counting(docs):
    rows = rules.ledger(docs(ODD))
    found = {(r.policy, r.rule): r for r in rules.ablation(rows).collect()}
    bits = [r.failed for r in rows.collect()]
    for (policy, rule), r in found.items():
        whole, bit = rules.POLICIES[policy], rules.BITS[rule]
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_only == sum(b & whole == bit for b in bits)
        assert r.n_kept == sum(b & whole == 0 for b in bits)
