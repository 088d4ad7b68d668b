"""The registered queries."""

from stateflux.plans import beat_queries, model_queries, parsing_queries, result_queries, sequence_queries, statistics_queries, table_queries, vector_queries  # noqa: F401
from stateflux.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
