"""Every registered query of the library against its SQL in DuckDB."""

import pytest

from lodestone.plans import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert_same(found.toPandas(), connect(sf_dir).sql(ORACLE_SQL[name]).df())
    else:
        found.count()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
