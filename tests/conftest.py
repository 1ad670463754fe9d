import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "plumbline-tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_DIR


@pytest.fixture
def rng():
    return np.random.default_rng(11)


@pytest.fixture
def frame(spark):
    """DataFrame from named columns of equal length."""

    def make(schema, **columns):
        rows = list(zip(*[[None if v is None else (v.item() if hasattr(v, "item") else v) for v in c] for c in columns.values()]))
        return spark.createDataFrame(rows, schema)

    return make
