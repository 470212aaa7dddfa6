"""Registry of named queries: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with an
    optional equivalent DuckDB SQL string."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    from . import q_graph, q_browse, q_ingest, q_docs, q_fold, q_sql, q_stream  # noqa: F401
