"""Importing this module registers every query."""

from workload import (  # noqa: F401
    analysis_queries,
    rollup_queries,
    source_queries,
    text_queries,
    training_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
