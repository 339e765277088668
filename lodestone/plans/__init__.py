"""Named queries composed of the operators, with their SQL."""

from lodestone.plans import activity, changes, code, corpus

QUERIES = corpus.QUERIES | activity.QUERIES | changes.QUERIES | code.QUERIES
ORACLE_SQL = corpus.ORACLE_SQL | activity.ORACLE_SQL | changes.ORACLE_SQL | code.ORACLE_SQL
