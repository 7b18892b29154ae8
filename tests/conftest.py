import pytest

from twinsieve.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "twinsieve-tests")
    yield session
    session.stop()
