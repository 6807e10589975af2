import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute as near_brute
from test_quality_rules import brute as measures
from test_suffix_dedup import brute as suffix_brute

import corpus_pipeline as cp
from tessella.llm import quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returns, written and read again."""
    top, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{top}/{k}")
        out.append(spark.read.parquet(f"{top}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert dict(df.dtypes) == dict(stages[0].dtypes)


def test_rules(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    ledger = {r.doc_id: r for r in quality_rules.ledger(stages[0]).collect()}
    for doc, text in before.items():
        n, _, _, _, repeat = measures(text)
        assert not ((n == 0 or 100 * repeat > 85 * n) and doc in after)
        assert (doc in after) == (ledger[doc].failed & quality_rules.POLICIES[cp.POLICY] == 0)
        assert doc not in after or after[doc] == text
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(d in after for d in before if labels.get(d) == 1)


def test_classifier(spark, stages):
    model = cp.quality_model(spark, SF, stages[0])
    want = {r.key for r in quality_classifier.scored(stages[1], model, F.col("doc_id")).collect() if r.score >= 0.3}
    assert set(texts(stages[2])) == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d in texts(stages[1]) if labels.get(d) == 1]
    assert sum(d in want for d in clean) >= 0.95 * len(clean)


def test_near_duplicates(stages):
    rows = list(texts(stages[2]).items())
    assert texts(stages[3]) == {d: t for d, t in rows if near_brute(rows, 5, 80)[d][1] == d}


def test_suffixes(stages):
    got = texts(stages[4])
    want = suffix_brute(list(texts(stages[3]).items()))
    assert {d: got[d].encode() for d, *_ in want} == {d: kept.decode("utf-8", "ignore").encode() for d, *_, kept in want}


def test_packing(stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    ids = {d: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts(stages[4]).items()}
    at = {}
    for r in sorted(stages[5].collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] = r.start + r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert at == {d: len(x) for d, x in ids.items()}


def test_odd_rows(spark, docs, shared):
    text = " ".join(f"word{k} und{k * k}" for k in range(60))
    table = docs([(None, text), (3, text), (3, text), (4, None), (None, "other " + text[5:300]), (None, "other " + text[5:300])])
    table = table.selectExpr("*", "1 as number", "2 as row", "3 as key")
    got = cp.near(spark, table, SF)
    assert got.columns == table.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in got.collect()) == [(-1, "other"), (3, "word0"), (4, "")]
    for _, stage in cp.STAGES[2:]:
        assert stage(spark, docs([]), SF).collect() == []
