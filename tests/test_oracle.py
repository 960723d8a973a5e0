"""Every registered check with an oracle must match DuckDB at sf0.01;
checks without one must run and keep a stable schema."""

import pytest

from tally.plans.registry import all_checks

from .conftest import SF_ORACLE
from .oracle_compare import compare, duck

CHECKS = all_checks()


@pytest.fixture(scope="module")
def con():
    c = duck(SF_ORACLE)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(n for n, c in CHECKS.items() if c.oracle))
def test_matches_oracle(spark, con, name):
    check = CHECKS[name]
    df = check.build(spark, SF_ORACLE)
    problems = compare(df, check.oracle, con)
    assert not problems, "\n".join(problems)


@pytest.mark.parametrize("name", sorted(n for n, c in CHECKS.items() if not c.oracle))
def test_runs_without_oracle(spark, name):
    df = CHECKS[name].build(spark, SF_ORACLE)
    first = df.schema
    n = df.count()
    assert n >= 0
    assert CHECKS[name].build(spark, SF_ORACLE).schema == first
