import pytest

import __spark_entry__ as registry
from checks.compare import connect, differences

SQL = {n: q for n, q in registry.oracle_sql().items() if n in registry.QUERIES}


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


def test_every_query_has_sql():
    assert set(SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(plan, con, name):
    df = registry._as_double(registry.QUERIES[name](plan))
    assert differences(df, SQL[name], con) == []
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "Python" not in physical


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["constituent_dim_id", "fiscal_year", "amount"] and df.count() > 0
