import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from adlumen.session import local_session, set_local_shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    set_local_shared_dir(session)
    return session


@pytest.fixture
def table(spark):
    """DataFrame from rows and a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)

    return make
