import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ROW = "_id string, question string, context string, model string, answer string, score double, overlap double"


@pytest.fixture(scope="session")
def table(spark):
    """Build a table of predictions from short rows."""
    def make(rows, schema=ROW):
        return spark.createDataFrame(rows, schema)
    return make
