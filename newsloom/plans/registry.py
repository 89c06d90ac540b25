"""Every query by name, with its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from . import composite, content, relational


def _statement(body: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir)
        return spark.sql(relational.spark_sql(body))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(body) for name, body in relational.SQL.items()} | composite.QUERIES | content.QUERIES
ORACLE_SQL: dict[str, str] = {name: tables.duckdb_sql(relational.duck_sql(body)) for name, body in relational.SQL.items()} | {name: tables.duckdb_sql(body) for name, body in (composite.ORACLE | content.ORACLE).items()}
