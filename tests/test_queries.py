"""Every registered core query against its SQL twin on the smallest data; queries without a twin must run."""

from pathlib import Path

import pytest

from oracle import differences, duck
from sedimenta.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, DATA).count() >= 0
    else:
        ours, theirs, a, b = differences(spark, con, DATA, query, sql)
        assert ours == theirs and not a and not b, (a, b)
