"""Every query of the reference's own operators against its SQL."""

import pytest

from tests.conftest import same
from waveloom.plans import registry, registry_cases, registry_more, registry_reviews, registry_sheets  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
