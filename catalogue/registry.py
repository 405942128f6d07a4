"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tidewatch.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def naive_times(df: DataFrame) -> DataFrame:
    """UTC instants as zone-free timestamps, the type of the tables themselves."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_times(build(use_utc(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add
