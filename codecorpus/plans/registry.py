"""Registry of named queries: a Spark builder and, where SQL can express
it, the equivalent DuckDB SQL over the same tables and derived views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from codecorpus.sources.tables import register, with_views


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    views: list[str] = field(default_factory=list)
    sql: str | None = None          # DuckDB body (views go in a WITH clause)
    doc: str = ""


QUERIES: dict[str, Query] = {}


def query(key: str, views: list[str] | None = None, sql: str | None = None):
    """Decorator: ``fn(spark) -> DataFrame`` runs after the views of
    ``sf_dir`` are registered as temp views."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir, views or [])
            return fn(spark)
        QUERIES[key] = Query(key, build, list(views or []), sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def oracle(key: str) -> str | None:
    q = QUERIES[key]
    if q.sql is None:
        return None
    return with_views(q.sql.strip(), q.views)


def load_all() -> dict[str, Query]:
    # importing the plan modules fills QUERIES
    from codecorpus.plans import (q_agents, q_changes, q_chat, q_corpus,  # noqa: F401
                                  q_edits, q_pages, q_streams)
    return QUERIES
