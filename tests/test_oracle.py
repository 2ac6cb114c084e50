"""Every registered query of the engine itself against its oracle SQL, or at least a run of it."""

import pytest

from cuesheet.plans import catalog
from tests.conftest import SMALL, assert_matches


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, name):
    assert_matches(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
