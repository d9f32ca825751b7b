import pytest

from loregraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
