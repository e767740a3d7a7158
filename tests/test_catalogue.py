"""Every query against its SQL on the smallest tables."""

import pytest

from strideline.plans import catalogue, catalogue_model  # noqa: F401 - adds its queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, compare, name):
    compare(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
