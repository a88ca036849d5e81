"""The queries of the engine by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from lexweave.plans import decoder_sql, segment_queries, text_queries

QUERIES = text_queries.QUERIES | segment_queries.QUERIES
ORACLE_SQL = text_queries.ORACLE_SQL | segment_queries.ORACLE_SQL | decoder_sql.ORACLE_SQL
flagship = segment_queries.flagship
