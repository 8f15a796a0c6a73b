import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session", autouse=True)
def swept(spark):
    """The tables that the tests cut go at the end."""
    yield
    from tessera.llm import common

    common.sweep(spark)
