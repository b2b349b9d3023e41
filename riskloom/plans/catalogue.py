"""Every query of the core by name, and the SQL that checks it."""

from __future__ import annotations

from . import code_queries, example_queries, graph_queries, model_queries, problems, process_queries

_PARTS = (process_queries, graph_queries, code_queries, example_queries, model_queries, problems)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
