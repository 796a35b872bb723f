import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest_rows import ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
