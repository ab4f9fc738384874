from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusdeck.session import measured_joins

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query, and the SQL that must give the same rows."""

    def register(run: Run) -> Run:
        @wraps(run)
        def measured(spark: SparkSession, sf: str) -> DataFrame:
            return run(measured_joins(spark), sf)

        QUERIES[name] = measured
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
