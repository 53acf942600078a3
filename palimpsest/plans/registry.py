"""All registered queries of the masking engine, and their SQL."""

from palimpsest.plans import queries, table_queries

QUERIES = {**queries.QUERIES, **table_queries.QUERIES}
SQL = {**queries.SQL, **table_queries.SQL}
