"""All registered queries: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from placerank.plans import content_queries, ranking_queries, run_queries

FLAGSHIP = "rank_by_category"
REGISTRY = {**ranking_queries.QUERIES, **run_queries.QUERIES, **content_queries.QUERIES}
