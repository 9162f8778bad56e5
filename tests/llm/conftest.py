import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import SCHEMA, frame, strange  # noqa: E402


@pytest.fixture(scope="session")
def strange_rows():
    return strange()


@pytest.fixture(scope="session")
def strange_docs(spark, strange_rows):
    return frame(spark, strange_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
