"""Every notebook question plans over a triple store and keeps its column order."""

import pytest

from tessella.plans.study import study_graph
from tessella.questions import QUESTIONS


@pytest.fixture(scope="module")
def study(spark):
    return study_graph(spark, "/root/testdata/sf0.001")


def test_all_are_there():
    groups = {}
    for uid in QUESTIONS:
        groups.setdefault(uid.split("/")[0], []).append(uid)
    assert {k: len(v) for k, v in groups.items()} == {"empirical": 61, "empirical_trends": 16, "language": 40, "language_survey": 10}


@pytest.mark.parametrize("uid", list(QUESTIONS))
def test_plans(study, uid):
    df = QUESTIONS[uid](study)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert not any(c.startswith("__") for c in df.columns)
