"""Every query of the core, in one list."""

from dataclasses import replace

from lexweave.plans import extended_queries, report_queries, structure_queries, text_queries

QUERIES = [*text_queries.QUERIES, *structure_queries.QUERIES, *report_queries.QUERIES, *extended_queries.QUERIES]
QUERIES = [replace(q, sql=extended_queries.SQL.get(q.name, q.sql)) for q in QUERIES]
