"""Every registered query of the library against its SQL."""

import pytest
from compare import DATA, database, difference

from albumlake.plans import registry


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, con):
    problem = difference(registry.QUERIES[name](spark, DATA), con, registry.ORACLES[name])
    assert problem is None, problem
