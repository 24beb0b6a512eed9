import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_spark

    s = get_spark("4", "quern-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
