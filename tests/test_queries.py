"""Every registered query of the mining engine against its SQL on the smallest tables."""

import pytest

from tests.compare import connection, rows
from trellis.plans import queries as plans


@pytest.fixture(scope="module")
def duck(data):
    return connection(f"{data}/sf0.001")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows_as_sql(spark, duck, data, name):
    got = plans.QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    if name in plans.SQL:
        assert rows(got) == rows(duck.execute(plans.SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
