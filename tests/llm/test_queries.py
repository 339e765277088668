"""Numbered queries against their SQL over the driver's tables."""

import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", ["op11_collocations", "op12_conversation_trie", "op13_exact_dedup"])
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLE_SQL[name]).df())
