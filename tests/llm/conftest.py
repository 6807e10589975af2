import pytest


@pytest.fixture
def shared(tmp_path):
    """A fresh folder for what an operator writes."""
    return str(tmp_path)


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
