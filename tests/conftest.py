"""One local session for all tests."""

import pytest

from parlance.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
