"""All registered queries, by key (see ``__spark_entry__.queries``)."""

from __future__ import annotations

from . import cohort_queries, eval_queries, guardrail_queries, io_queries

QUERIES = {}
QUERIES.update(cohort_queries.QUERIES)
QUERIES.update(guardrail_queries.QUERIES)
QUERIES.update(eval_queries.QUERIES)
QUERIES.update(io_queries.QUERIES)
