"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from tessera.plans import grid_queries, run_queries, score_queries, source_queries, table_queries  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
