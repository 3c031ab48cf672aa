"""All queries by name, and the SQL they are held against."""

from tallyspark.plans import run_queries, text_queries

QUERIES = {**run_queries.QUERIES, **text_queries.QUERIES}
ORACLE_SQL = {**run_queries.ORACLE_SQL, **text_queries.ORACLE_SQL}
