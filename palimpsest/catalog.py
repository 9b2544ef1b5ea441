"""The registry of queries over the reference operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is what DuckDB runs for it, None where SQL has no such operation."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


from .plans import audit, capability, checkpoints, composites, containers, eventlog, evidence, functions, hooks, literals, projection, replay, reports, scoring, sequences, streams, transcripts  # noqa: E402, F401
