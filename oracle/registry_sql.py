"""All oracle SQL statements, by query key."""

from __future__ import annotations

from . import cohort_queries_sql, eval_sql, guardrail_sql, io_sql

SQL = {}
SQL.update(cohort_queries_sql.SQL)
SQL.update(guardrail_sql.SQL)
SQL.update(eval_sql.SQL)
SQL.update(io_sql.SQL)
