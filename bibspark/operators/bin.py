"""Soft-delete bin: entries are rows of (id, original_path, recycle_path, file_name, file_size, deleted_at, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, stem


def safe_name(deleted: Column, entry_id: Column, name: Column) -> Column:
    return F.concat(F.date_format(deleted, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(entry_id, 1, 8), F.lit("_"), name)


def delete(rows: DataFrame, folder: str = "/bin/files") -> DataFrame:
    """Entries for ``rows`` (entry_id, file_path, file_size, deleted timestamp, metadata map); rows without a path give none."""
    name = file_name(F.col("file_path"))
    return rows.filter(F.coalesce("file_path", F.lit("")) != "").select(
        F.col("entry_id").alias("id"),
        F.col("file_path").alias("original_path"),
        F.concat(F.lit(f"{folder}/"), safe_name(F.col("deleted"), F.col("entry_id"), name)).alias("recycle_path"),
        name.alias("file_name"),
        "file_size",
        F.date_format("deleted", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("deleted_at"),
        "metadata",
    )


def restore(entries: DataFrame, ids: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, restored_path) of the entries named in ``ids`` (id). A path taken in ``existing`` (file_path), or by an earlier restored entry, gets
    ``_restored{n}`` with the smallest free n from 1."""
    wanted = entries.join(ids, "id", "left_semi").select("id", "original_path")
    base = stem(F.col("original_path"))
    folder = F.regexp_extract("original_path", "^(.*/)?[^/]*$", 1)
    ext = F.expr("substring(original_path, length(folder) + length(base) + 1)")
    own = wanted.withColumns({"base": base, "folder": folder}).withColumn("ext", ext)
    taken = existing.select(F.col("file_path").alias("path")).distinct()
    own = own.join(taken.select("path", F.lit(1).alias("hit")), own.original_path == F.col("path"), "left").drop("path")
    turn = F.row_number().over(Window.partitionBy("original_path").orderBy("id")) - F.when(F.col("hit").isNull(), 1).otherwise(0)
    own = own.withColumn("turn", turn)
    # numbers already taken for the path, found by taking existing names apart
    apart = taken.select(F.regexp_extract("path", "^(.*)_restored([0-9]+)(\\.[^./]*)?$", 1).alias("head"), F.regexp_extract("path", "^(.*)_restored([0-9]+)(\\.[^./]*)?$", 2).try_cast("int").alias("n"), F.regexp_extract("path", "^(.*)_restored([0-9]+)(\\.[^./]*)?$", 3).alias("tail"))
    used = apart.filter("n is not null").groupBy("head", "tail").agg(F.collect_set("n").alias("used"))
    met = own.join(used, (F.concat("folder", "base") == F.col("head")) & (F.col("ext") == F.col("tail")), "left")
    free = F.filter(F.sequence(F.lit(1), F.col("turn") + F.size(F.coalesce("used", F.array().cast("array<int>")))), lambda n: ~F.coalesce(F.array_contains("used", n), F.lit(False)))
    name = F.when(F.col("turn") == 0, F.col("original_path")).otherwise(F.concat("folder", "base", F.lit("_restored"), F.try_element_at(free, F.col("turn").cast("int")).cast("string"), "ext"))
    return met.select("id", name.alias("restored_path"))


def purge(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids, "id", "left_anti")


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("deleted_at"), "id")


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))


def expired(deleted_at: Column, now: Column, days: int) -> Column:
    """Older than ``days`` at ``now``; never for days of 0 or less or for what is no date."""
    if days <= 0:
        return F.lit(False)
    return F.coalesce(F.try_to_timestamp(deleted_at) < now - F.make_interval(days=F.lit(days)), F.lit(False))


def cleanup(entries: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, entries removed)."""
    old = expired(F.col("deleted_at"), now, days)
    return entries.filter(~old), entries.filter(old)


def without_removed(books: DataFrame, entries: DataFrame) -> DataFrame:
    """The catalogue without what lies in the bin."""
    return books.join(entries.select(F.col("original_path").alias("file_path")), "file_path", "left_anti")
