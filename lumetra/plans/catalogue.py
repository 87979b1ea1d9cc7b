"""Every registered query with its oracle SQL."""

from . import collection_queries, evaluation_queries, linkage_queries, model_queries, table_queries, text_queries, workflow_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
