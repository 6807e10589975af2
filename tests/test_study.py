"""The scholarly graph is read from the orders by pattern: nothing is stored, and kinds leave no triple out."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessella import session
from tessella.operators import graph as g
from tessella.plans import study
from tessella.questions import QUESTIONS
from tessella.questions.common import CONTRIBUTION, VENUE


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Sixty orders, one of them twice, and one without a key."""
    day = datetime.datetime(1994, 5, 17)
    rows = [(k, k % 7, day) for k in [*range(60), 4]] + [(None, 1, day)]
    folder = tmp_path_factory.mktemp("study")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("uid", ["empirical/04"])
def test_nothing_is_written(spark, orders, monkeypatch, uid):
    def refuse(*_):
        raise AssertionError("a question writes triples")

    monkeypatch.setattr(session, "scratch_dir", refuse)
    monkeypatch.setattr(study, "scratch_dir", refuse, raising=False)
    assert QUESTIONS[uid](study.study_graph(spark, orders)).count() > 0


def test_a_pattern_reads_the_orders_once_for_each_kind(spark, orders):
    t = study.study_graph(spark, orders)

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")

    assert scans(g.pattern(t, g.LABEL, kind=f"^{CONTRIBUTION}")) == 1
    assert scans(g.pattern(t, g.LABEL, kind="orkgp:P56008")) == 1
    assert scans(g.pattern(t, g.LABEL, kind=VENUE)) == 0
    assert scans(g.pattern(t, g.LABEL)) > 20


def test_kinds_hold_all_triples_of_their_subjects(spark, orders):
    t = study.study_graph(spark, orders)
    labels = g.pattern(t, g.LABEL).collect()
    for kind in ("orkgp:P1005", VENUE):
        led = {r.o for r in g.pattern(t, kind, None).collect()}
        some = g.pattern(t, g.LABEL, kind=kind).collect()
        assert sorted(r for r in some if r.s in led) == sorted(r for r in labels if r.s in led) != []
    assert t.about("orkgp:unknown") is t


def test_a_repeated_order_repeats_its_labels_only(spark, orders):
    t = study.study_graph(spark, orders)
    twice = F.col("s").rlike("^contribution/4(/|$)")
    below = [tuple(r) for r in g.pattern(t, ["orkgp:P15124", "orkgp:P56008"]).filter(twice).collect()]
    assert len(below) == len(set(below)) > 0
    labels = g.pattern(t, g.LABEL, kind="orkgp:P56008").union(g.pattern(t, g.LABEL, kind="orkgp:P15124")).filter(twice).groupBy("s", "o").count()
    assert {r["count"] for r in labels.collect()} == {2}
    assert {r["n"] for r in g.pattern(t, CONTRIBUTION).filter("s = 'paper/4'").groupBy("s").agg(F.count("*").alias("n")).collect()} == {2}
