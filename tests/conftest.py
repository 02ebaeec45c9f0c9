import pytest

from .spark_session import session


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
