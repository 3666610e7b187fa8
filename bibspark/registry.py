"""All queries of the library by name, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalogue_queries, scalar_queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISBN-exact duplicate groups with the bytes that they could save."""
    return catalogue_queries.ded01(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scalar_queries.catalogue.runs | catalogue_queries.catalogue.runs


def oracle_sql() -> dict[str, str]:
    return scalar_queries.catalogue.oracles | catalogue_queries.catalogue.oracles
