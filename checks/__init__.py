"""Queries over the given tables with the SQL that checks them.

Each module registers pairs with :func:`check`; ``__spark_entry__`` collects them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from faultline.session import configure

            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    import importlib
    for module in MODULES:
        importlib.import_module(f"checks.{module}")


MODULES = ["lines", "gate", "matching", "temporal", "text", "tickets", "retrieval", "scoring", "chunks", "crash",
           "telemetry", "records", "triage", "streams", "sources"]
