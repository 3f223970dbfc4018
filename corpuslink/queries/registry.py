"""Where the library's queries over the given tables are registered, each with its DuckDB check when SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslink.plans.fixtures import VIEW_SQL
from corpuslink.session import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(views: str, body: str) -> str:
    """``body`` (``SELECT …`` or further ``name AS (…) … SELECT …``) with the named views defined before it."""
    parts = [f"{name} AS ({VIEW_SQL[name]})" for name in views.split()]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
    return f"WITH RECURSIVE {', '.join([*parts, body])}"


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its check in DuckDB over ``views``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tuned(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return register


def r6(value: Column | str) -> Column:
    """A double rounded to six places, never −0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)
