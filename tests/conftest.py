import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(os.environ.get("TEST_CPUS", "8"))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
