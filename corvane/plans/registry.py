"""The registered queries, and the SQL that gives the same rows in DuckDB."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import board

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its name, with its SQL, which may use the views of board.VIEWS."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"with {board.VIEWS.strip()} {sql.strip()}"
        return f

    return keep
