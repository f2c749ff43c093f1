import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomlight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("loomlight-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]
