import pytest

from tessella.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tessella-tests")


@pytest.fixture(scope="session")
def campus(spark):
    from campus import triples

    return spark.createDataFrame(triples(), "s string, p string, o string, o_kind string, dtype string, lang string").cache()
