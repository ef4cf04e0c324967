"""Every catalogue query against its DuckDB SQL at sf0.01 (the driver's gate)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from conftest import SF_ORACLE, SF_SMALL  # noqa: E402

from tablesteps.plans import catalogue as C  # noqa: E402

C.load_all()
ORACLE = C.ORACLE
NAMES = sorted(C.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, n, _, detail = compare(spark, con, name, C.QUERIES[name], ORACLE[name], SF_ORACLE)
    assert ok, detail


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns[:2] == ["l_returnflag", "l_linestatus"]
