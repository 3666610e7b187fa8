"""Registry of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture import BOOKS_SQL

Run = Callable[[SparkSession, str], DataFrame]
#: DuckDB prefix that makes the book catalogue.
BOOKS = f"WITH books AS ({BOOKS_SQL.strip()})"


class Catalogue:
    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def add(run: Run) -> Run:
            self.runs[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return run

        return add
