"""All queries of this subpackage and their SQL."""

from larkspan.llm import queries_a, queries_b, queries_c, queries_d

QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES, **queries_d.QUERIES}
SQL = {**queries_a.SQL, **queries_b.SQL, **queries_c.SQL, **queries_d.SQL}
