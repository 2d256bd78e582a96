"""All queries of this subpackage and the SQL of those that SQL can express."""

from . import queries_native, queries_text, queries_token

QUERIES = {**queries_native.QUERIES, **queries_text.QUERIES, **queries_token.QUERIES}
ORACLE_SQL = {**queries_native.ORACLE_SQL, **queries_text.ORACLE_SQL, **queries_token.ORACLE_SQL}
