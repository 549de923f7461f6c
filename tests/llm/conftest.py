import pytest

from meldwork.llm.common import purge


@pytest.fixture(scope="session", autouse=True)
def purged(spark):
    """Intermediate tables go when the tests of this folder are done."""
    yield
    purge(spark)
