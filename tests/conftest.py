import pytest

from geoloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__adaptive__enabled="true")
    yield session
    session.stop()
