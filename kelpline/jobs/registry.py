"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from kelpline.jobs import core_queries, search_queries

QUERIES = {**core_queries.QUERIES, **search_queries.QUERIES}
ORACLES = {**core_queries.ORACLES, **search_queries.ORACLES}
