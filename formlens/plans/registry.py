"""Query registry: each query is a function of (spark, sf_dir) beside the SQL that DuckDB compares it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formlens.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF, DAYS = "2024-01-30 23:59:59", 30


def query(name: str, build: Callable[..., DataFrame], tables: str, sql: str | None = None) -> None:
    """Register ``build`` over the named product tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(*(view(spark, sf_dir, t) for t in tables.split()))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql)
