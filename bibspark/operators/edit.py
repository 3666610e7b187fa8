"""Catalogue edits as projections: nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITABLE = ("title", "author", "publisher", "publish_date", "isbn", "language", "description", "tags")


def apply_batch(books: DataFrame, changes: dict[str, object], selected: Column | None = None) -> DataFrame:
    """Each truthy value overwrites that field of the selected rows; unknown fields are ignored, and no field can be blanked."""
    where = F.lit(True) if selected is None else selected
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
    return books.withColumns({c: F.when(where, value(v)).otherwise(F.col(c)) for c, v in changes.items() if v and c in books.columns and c in EDITABLE})


def apply_single(books: DataFrame, file_path: str, changes: dict[str, object]) -> DataFrame:
    return apply_batch(books, changes, F.col("file_path") == file_path)


def merge_from_source(books: DataFrame, source: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("title", "author", "publisher", "publish_date", "isbn", "language", "description"), overwrite: bool = False) -> DataFrame:
    """Fill empty fields from ``source`` (one row per key), or overwrite whatever it has."""
    fields = tuple(f for f in fields if f in source.columns and f in books.columns)
    met = books.join(source.select(key, *(F.col(f).alias(f"__new_{f}") for f in fields)), key, "left")

    def merged(f: str) -> Column:
        own, new = F.coalesce(F.col(f), F.lit("")), F.coalesce(F.col(f"__new_{f}"), F.lit(""))
        return F.when((new != "") & (F.lit(overwrite) | (own == "")), new).otherwise(own)

    return met.select(*(merged(c).alias(c) if c in fields else F.col(c) for c in books.columns))


def tags_of(text: Column) -> Column:
    """Comma-separated tags, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
