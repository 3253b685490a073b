"""Queries of the training-data operators that SQL can express, against their SQL."""

import os
import sys

import pytest

from albumlake.llm import queries as Q

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import DATA, database, difference  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(name, spark):
    problem = difference(Q.QUERIES[name](spark, DATA), database(), Q.ORACLES[name])
    assert problem is None, problem
