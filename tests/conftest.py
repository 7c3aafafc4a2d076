import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chorus.schema import POST_SCHEMA  # noqa: E402
from chorus.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", "chorus-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def make_posts(spark):
    def make(rows):
        return spark.createDataFrame(rows, POST_SCHEMA)
    return make
