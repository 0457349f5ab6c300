import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from qamill.session import get_session
    s = get_session("local[4]", 8)
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path_factory):
    """A fresh scratch folder per test."""
    return str(tmp_path_factory.mktemp("run"))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
