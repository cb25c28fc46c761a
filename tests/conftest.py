import pytest

from conceptflow.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
