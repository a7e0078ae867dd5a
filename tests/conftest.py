import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="ledgerloom-test-")
