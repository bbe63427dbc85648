"""All base queries by name, with the SQL that states their result."""

from barloom.plans import decision_queries, indicator_queries, model_queries, probe_queries, report_queries, signal_queries, state_queries

QUERIES: dict = {**report_queries.QUERIES, **indicator_queries.QUERIES, **decision_queries.QUERIES, **model_queries.QUERIES, **signal_queries.QUERIES, **probe_queries.QUERIES, **state_queries.QUERIES}
ORACLE_SQL: dict = {**report_queries.SQL, **indicator_queries.SQL, **decision_queries.SQL, **model_queries.SQL, **signal_queries.SQL, **probe_queries.SQL, **state_queries.SQL}
