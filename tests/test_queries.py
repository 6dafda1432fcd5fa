"""Every query against its SQL."""

import pytest

import __spark_entry__
from corundum.plans import base as q
from tests.conftest import SF, same_rows


__spark_entry__.queries()  # registers them


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = same_rows(q.QUERIES[name](spark, SF), duck, q.ORACLES[name])
    assert ours == theirs
    assert ours, "a query that finds nothing proves nothing"


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 3
    assert set(q.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
