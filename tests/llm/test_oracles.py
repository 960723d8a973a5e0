"""Queries of the subpackage against DuckDB at sf0.01."""

import pytest

from tally.llm.checks import ORACLES, QUERIES

from ..conftest import SF_ORACLE
from ..oracle_compare import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    con = duck(SF_ORACLE)
    try:
        assert not compare(QUERIES[name](spark, SF_ORACLE), ORACLES[name], con)
    finally:
        con.close()
