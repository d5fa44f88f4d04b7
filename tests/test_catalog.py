"""Every query of the record model against its SQL, and the ones without SQL for their shape."""

import pytest

from strataloom.plans.catalog import QUERIES, SQL

from .compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
