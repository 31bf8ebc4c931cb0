"""The registered queries of the engine, Q, and the DuckDB SQL of the same rows, SQL, by name."""

from __future__ import annotations

from corpusloom.plans import corpus_queries, index_queries, record_queries, search_queries  # noqa: F401
from corpusloom.plans.search_queries import SQL, Q  # noqa: F401
