import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

from receptorium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("receptorium-tests", "8", "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()



@pytest.fixture(scope="session")
def make_index(spark):
    """Index table from partial rows; src_row is the row order."""
    from receptorium.constants import INDEX_COLUMNS as cols

    def make(rows):
        schema = ", ".join(f"{c} string" for c in cols) + ", src_row long"
        return spark.createDataFrame([tuple(r.get(c) for c in cols) + (i,) for i, r in enumerate(rows)], schema)

    return make
