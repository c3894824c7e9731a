"""Registry of named queries and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemoframe.sources.views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable:
    """Register a function of the named views as a query; ``sql`` may name views in braces."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(*(view(spark, sf_dir, v) for v in views))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return function

    return register
