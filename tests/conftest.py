import pytest

from rivulet.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "rivulet-tests")
    yield session
    session.stop()
