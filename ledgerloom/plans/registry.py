"""Query registry: a Spark query and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as ISO strings, the types the SQL side returns."""
    def one(field):
        kind = field.dataType.typeName()
        if kind == "decimal":
            return F.col(field.name).cast("double").alias(field.name)
        if kind == "date":
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[one(f) for f in df.schema.fields])


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is already registered")
    QUERIES[name] = lambda spark, sf_dir: comparable(query(spark, sf_dir))
    if sql:
        SQL[name] = sql
