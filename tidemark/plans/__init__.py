"""Every query of the engine, by name, with the SQL that must agree."""

from . import aggregate_queries, check_queries, codec_queries, inference_queries, registry_queries, rule_queries, state_queries, text_queries, vector_queries  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
