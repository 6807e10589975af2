import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import quality_classifier as qc
from tessella.llm.queries import op10

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op10(spark, SF).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    x, bounds = rng.normal(size=(30, len(qc.FEATURES))), np.array([0, 5, 6, 20, 30])
    y = np.array([0.0, 1, 1, 0])
    loss = lambda m: -np.log(np.where(y == 1, (p := m.scores(x, bounds)), 1 - p)).mean()
    untrained, steps = qc.STEPS, []
    try:
        for qc.STEPS in (1, 20, 100):
            steps.append(loss(qc.train(x, bounds, y)))
    finally:
        qc.STEPS = untrained
    assert steps[0] > steps[1] > steps[2]


def test_attention_weighs_passages_by_document():
    bounds = np.array([0, 3, 4])
    out = qc._forward(qc.train(np.eye(4, len(qc.FEATURES)), bounds, np.array([0.0, 1])).weights, np.eye(4, len(qc.FEATURES)), bounds)
    assert np.allclose(np.add.reduceat(out[5], bounds[:-1]), 1)


def test_odd_rows_and_clashing_columns(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n"), (3, "a b c"), (None, "x " * 60_000), (5, "### $$$ |")]
    table = docs(rows).selectExpr("*", "1 as key", "2 as score", "3 as quality")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (9, 1), (None, 0), (5, 0), (2, 7)], "doc_id bigint, quality int")
    model = qc.fit(table, labels)
    out = qc.scored(table, model, F.col("doc_id")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.key in (1, 2)}) == 1
    assert qc.keep(table, qc.Model({}, 1.0)).schema == table.schema
    assert qc.keep(table, qc.Model({}, 1.0)).count() == len(rows)
    assert qc.fit(table, labels.limit(0)).constant == 1.0
    assert qc.scored(docs([]), model, F.col("doc_id")).collect() == []


def test_passages_cover_every_word():
    x, bounds = qc.passages(pa.table({"text": ["w " * 100, "", None, "\n".join("ab" * 50)]}))
    assert np.diff(bounds).tolist() == [3, 1, 1, 3]
    assert np.allclose(np.add.reduceat(x[:, 0], bounds[:-1]) * qc.PASSAGE, [100, 0, 0, 100])


def test_scores_equal_a_loop_over_passages():
    rng = np.random.default_rng(5)
    table = pa.table({"text": [" ".join(rng.choice(["a", "Bc", "d!", "###", "efg.", "12\n"], n)) for n in (0, 1, 47, 48, 49, 500)]})
    x, bounds = qc.passages(table)
    model = qc.train(x, bounds, np.array([0.0, 1, 0, 1, 1, 0]))
    w, want = model.weights, []
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hidden, weight = [], []
        for p in range(a, b):
            scaled = [(x[p][f] - w["mean"][f]) / w["scale"][f] for f in range(len(qc.FEATURES))]
            h = [math.tanh(sum(v * w["encode"][f][k] for f, v in enumerate(scaled)) + w["encode0"][k]) for k in range(qc.HIDDEN)]
            dot = lambda name, g, h=h: sum(v * w[name][k][g] for k, v in enumerate(h))
            weight.append(math.exp(sum(math.tanh(dot("attend", g)) * sigmoid(dot("gate", g)) * w["weigh"][g] for g in range(qc.GATE))))
            hidden.append(h)
        z = [sum(e * h[k] for e, h in zip(weight, hidden, strict=True)) / sum(weight) for k in range(qc.HIDDEN)]
        want.append(sigmoid(sum(v * w["out"][k] for k, v in enumerate(z)) + w["out0"][0]))
    assert np.allclose(model.scores(x, bounds), want)


def test_fitting_takes_whole_texts_within_its_bound(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(qc, "train", lambda x, bounds, y: seen.append((len(x), sorted(np.diff(bounds).tolist()))))
    table = docs([(k, "w " * qc.PASSAGE * n) for k, n in enumerate((300, 80, 90, 70, 1, 2))])
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id bigint, quality int")
    qc.fit(table, labels)
    qc.fit(table, labels, most=900)
    qc.fit(table, labels, most=200)
    assert seen[0] == (543, [1, 2, 70, 80, 90, 300])
    assert seen[1] == (243, [1, 2, 70, 80, 90])
    assert seen[2] == (3, [1, 2])
