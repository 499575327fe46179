"""All queries of the library, by the identifiers of the survey, with their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the SQL that must give the same rows."""

    def put(run: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return put


def _load() -> None:
    from folio.plans import assembly, concepts, drafts, layout, markup, more, nested, quality, quizzes, relational, restore, retrieval, scalar, split  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLE)
