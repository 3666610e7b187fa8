"""Reports over groups and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import human_size
from . import recommend


def overview(stats: DataFrame) -> DataFrame:
    share = F.when(F.col("total_size") > 0, F.col("saved_size") / F.col("total_size") * 100).otherwise(0.0)
    return stats.select("total_groups", "total_books", "removable", "total_size", "saved_size", share.alias("saved_percent"))


def distribution(rows: DataFrame, key: str, labels: dict[str, str] | None = None) -> DataFrame:
    """(key, label, n, percent), most frequent first."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    label = F.col(key)
    if labels:
        label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), F.col(key)), F.col(key))
    return counts.select(key, label.alias("label"), "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("percent")).orderBy(F.desc("n"), key)


def match_distribution(groups: DataFrame) -> DataFrame:
    return distribution(groups, "match_type", K.MATCH_LABELS)


def group_details(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, match_type, similarity, n_books, first_title, size, saving if the largest and if the best-scored stays)."""
    per = recommend.ranked(recommend.scored(members)).groupBy("group_id").agg(
        F.min_by("title", "member_pos").alias("first_title"),
        F.sum("file_size").alias("size"),
        (F.sum("file_size") - F.max("file_size")).alias("saved_size"),
        F.sum(F.when(F.col("rank") > 1, F.col("file_size")).otherwise(0)).alias("actual_saved_size"),
    )
    return groups.join(per, "group_id")


def compare_view(ranked_members: DataFrame) -> DataFrame:
    """Ranked members of each group with scores and reasons."""
    own = ranked_members.withColumn("keep_reasons", recommend.keep_reasons())
    preview = F.substring(F.coalesce("text_preview", F.lit("")), 1, 300)
    return own.select("group_id", "rank", "ord", "title", "author", "score", "metadata_score", "keep_reasons", human_size(F.col("file_size")).alias("size_text"), preview.alias("preview"))


def catalogue_filter(books: DataFrame, file_format: str = "", keyword: str = "") -> DataFrame:
    """Books of the format (any if empty) whose title, author, ISBN and publisher contain the keyword, ignoring case."""
    text = F.lower(F.concat_ws(" ", "title", "author", "isbn", "publisher"))
    out = books.filter(F.upper("file_format") == file_format.upper()) if file_format else books
    return out.filter(F.contains(text, F.lit(keyword.lower()))) if keyword else out


def catalogue_view(books: DataFrame) -> DataFrame:
    return books.select("ord", "title", "author", "publisher", "isbn", "language", F.upper("file_format").alias("format_label"), human_size(F.col("file_size")).alias("size_text"), "file_path")


def sorted_catalogue(books: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Text columns by code point, sizes as numbers; ties by catalogue order."""
    return books.orderBy(F.desc(by) if descending else F.asc(by), "ord")


def bin_listing(entries: DataFrame) -> DataFrame:
    """Deleted files, newest first, with readable size and date (the raw text if it is no date)."""
    when: Column = F.coalesce(F.date_format(F.try_to_timestamp("deleted_at"), "yyyy-MM-dd HH:mm:ss"), F.col("deleted_at"))
    field = lambda name: F.coalesce(F.try_element_at("metadata", F.lit(name)), F.lit(""))
    return entries.select("id", "file_name", human_size(F.col("file_size")).alias("size_text"), when.alias("deleted_text"), field("title").alias("title"), field("author").alias("author"), "deleted_at").orderBy(F.desc("deleted_at"), "id")
