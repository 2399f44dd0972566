import pytest

from sievewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, partitions=4, memory="4g")
    yield session
    session.stop()
