"""All queries over the driver tables, with the same results as DuckDB SQL.

Transactions are made from events, the reference corpus from embeddings:
components are moved from [-1, 1] to [0, 1] and quantised, and a label of 5 or
more stands for fraud.
"""

from __future__ import annotations

from .plans import index_queries, request_queries, scalar_queries

QUERIES = scalar_queries.QUERIES | index_queries.QUERIES | request_queries.QUERIES
SQL = scalar_queries.SQL | index_queries.SQL | request_queries.SQL
