import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veilspark.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="veilspark-tests")
    yield s


@pytest.fixture
def one_col(spark):
    """Make a one-column DataFrame of texts: one_col(["a", "b"])."""
    def make(texts, name="text"):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"row_index long, {name} string")

    return make
