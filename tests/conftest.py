import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tablesteps.session import build_session

    s = build_session("local[4]", "tablesteps-tests")
    yield s


@pytest.fixture()
def tmpdir_shared(spark):
    from tablesteps.session import local_path, shared_dir

    p = local_path(shared_dir(spark, "test"))
    os.makedirs(p, exist_ok=True)
    return p


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
