import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dosewise import session as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = S.local_session("4", memory="4g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    touched = []

    def put(key, value):
        touched.append(key)
        spark.conf.set(key, str(value))

    yield put
    for key in touched:
        spark.conf.unset(key)
