import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tagwave.session import local_session

    s = local_session("*", shuffle_partitions=8, app="tagwave-tests")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_cached():
    """Tables that a module's tests cached go with it: another module's plans must show their own scans."""
    yield
    from pyspark.sql import SparkSession

    if (session := SparkSession.getActiveSession()) is not None:
        session.catalog.clearCache()
