import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def workspace(spark, tmp_path):
    from orderlight.sources.workspace import Workspace

    return Workspace(spark, str(tmp_path / "ws"))


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
