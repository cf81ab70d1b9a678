import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsmill.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
