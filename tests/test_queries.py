"""Every query of the library against its SQL; those without SQL give rows."""

import pytest
from oracle import compare

from skerry import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    if name in SQL:
        compare(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
