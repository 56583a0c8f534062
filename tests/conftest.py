import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lakehealth.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf0001():
    return "/root/testdata/sf0.001"
