import pytest

from caselight.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.driver.memory": "4g"})
    yield s
    s.stop()
