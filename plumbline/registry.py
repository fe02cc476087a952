"""Queries over the driver's tables by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that must return the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid retrieval query."""
    return QUERIES["hybrid_section_dedup"](spark, sf_dir)


from .plans import calendars, evidence, fulltext, geometry, narratives, networks, prose, questions, rendering, reports, retrieval, review, rows, scalars, schedule, selection, shapes, stores, streams, texts  # noqa: E402, F401  (they register their queries)
