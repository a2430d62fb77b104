"""All registered queries over the stand-in views, and their SQL."""

from __future__ import annotations

from cellweft.plans import cells_queries, network_queries, source_queries, time_queries

QUERIES: dict = {**source_queries.Q, **cells_queries.Q, **network_queries.Q, **time_queries.Q}
SQL: dict = {**source_queries.SQL, **cells_queries.SQL, **network_queries.SQL, **time_queries.SQL}
