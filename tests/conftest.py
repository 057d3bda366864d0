import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evidora.session import build

    session = build("local[4]", 2)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
