"""Registered queries against their DuckDB oracles."""

import sys

import pytest

from termtrail.llm import registry
from tests.conftest import ROOT, SMALL

sys.path.insert(0, f"{ROOT}/tools")
import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert compare.compare(spark, compare.connect(SMALL), SMALL, name) is None
