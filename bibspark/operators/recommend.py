"""Which copy of a duplicate group to keep: scores, ranks, reasons. Native window expressions.

Input: a frame of group members with group_id, member_pos and the books' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fingerprint import completeness
from ..functions.text import file_name


def metadata_score(stored: Column | None = None) -> Column:
    return completeness() if stored is None else F.when(stored > 0, stored).otherwise(completeness())


def format_score(file_format: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in K.FORMAT_SCORES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(file_format)), F.lit(K.OTHER_FORMAT_SCORE))


def size_score(size: Column, low: Column, high: Column, mean: Column) -> Column:
    """1 at the group's mean size, one half at its extremes; ``low``, ``high`` and ``mean`` are over positive sizes, null if there are none."""
    below = F.when(mean > low, (size - low) / F.nullif(mean - low, F.lit(0.0))).otherwise(1.0)
    above = F.when(high > mean, (high - size) / F.nullif(high - mean, F.lit(0.0))).otherwise(1.0)
    return F.when(low.isNull(), 0.5).when(size == 0, 0.3).when(high == low, 1.0).when(size <= mean, 0.5 + below * 0.5).otherwise(0.5 + above * 0.5)


def quality_score(simhash: Column, preview: Column, cover: Column, tags: Column) -> Column:
    text = F.when(simhash != 0, F.when(F.length(preview) > 500, 0.2).when(F.length(preview) > 200, 0.1).otherwise(0.0)).otherwise(0.0)
    own = 0.5 + text + F.when(F.coalesce(cover, F.lit("")) != "", 0.15).otherwise(0.0) + F.when(F.size(tags) > 0, 0.1).otherwise(0.0)
    return F.least(own, F.lit(1.0))


def filename_score(path: Column, title: Column, author: Column) -> Column:
    name = file_name(path)
    low, score = F.lower(name), F.lit(0.5)
    has = lambda where, what: F.contains(where, F.lit(what))
    for word in K.BAD_NAME_WORDS:
        score = score - F.when(has(low, word), 0.15).otherwise(0.0)
    score = score - F.when(has(name, "[") & has(name, "]"), 0.1).otherwise(0.0) - F.when(has(name, "(") & has(name, ")"), 0.05).otherwise(0.0)
    for part, gain in ((title, 0.2), (author, 0.1)):
        score = score + F.when((part != "") & F.contains(name, part), gain).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def scored(members: DataFrame) -> DataFrame:
    """Adds metadata_score, format_score, size_score, quality_score, filename_score and their weighted sum ``score``."""
    group = Window.partitionBy("group_id")
    size = F.when(F.col("file_size") > 0, F.col("file_size"))
    low, high, mean = F.min(size).over(group), F.max(size).over(group), F.avg(size).over(group)
    own = members.withColumns({"__low": low, "__high": high, "__mean": mean}).withColumns(
        {
            "metadata_score": metadata_score(F.col("metadata_completeness")),
            "format_score": format_score(F.col("file_format")),
            "size_score": size_score(F.col("file_size"), F.col("__low"), F.col("__high"), F.col("__mean")),
            "quality_score": quality_score(F.col("simhash"), F.col("text_preview"), F.col("cover_path"), F.col("tags")),
            "filename_score": filename_score(F.col("file_path"), F.col("title"), F.col("author")),
        }
    )
    total = F.lit(0.0)
    for name, weight in K.KEEP_WEIGHTS.items():
        total = total + F.col(f"{name}_score") * weight
    return own.withColumn("score", total).drop("__low", "__high", "__mean")


def ranked(scored_members: DataFrame) -> DataFrame:
    """Adds rank from 1: by score, then place in the group. Scores equal to nine digits are ties, as their sums are rounded differently from engine to engine."""
    return scored_members.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc(F.round("score", 9)), "member_pos")))


def keepers(scored_members: DataFrame) -> DataFrame:
    return ranked(scored_members).filter("rank = 1")


def _with(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def keep_reasons() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("format_score") >= 0.9, _with(K.KEEP_FORMAT, F.upper("file_format"))),
            F.when(F.col("metadata_score") >= 0.8, F.lit(K.KEEP_METADATA)),
            F.when(F.col("size_score") >= 0.8, F.lit(K.KEEP_SIZE)),
            F.when(F.coalesce("cover_path", F.lit("")) != "", F.lit(K.KEEP_COVER)),
            F.when(F.length("text_preview") > 300, F.lit(K.KEEP_TEXT)),
        )
    )


def removal_reasons(ranked_members: DataFrame) -> DataFrame:
    """Members other than the keeper, with keep_ord and removal_reasons against it."""
    names = ("ord", "metadata_completeness", "format_score", "file_size", "cover_path")
    keep = ranked_members.filter("rank = 1").select("group_id", *(F.col(c).alias(f"keep_{c}") for c in names))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("metadata_completeness") < F.col("keep_metadata_completeness"), F.lit(K.DROP_METADATA)),
            F.when(F.col("format_score") < F.col("keep_format_score"), _with(K.DROP_FORMAT, F.upper("file_format"))),
            F.when(F.col("file_size") > F.col("keep_file_size") * 1.5, F.lit(K.DROP_LARGE)),
            F.when(F.col("file_size") < F.col("keep_file_size") * 0.5, F.lit(K.DROP_SMALL)),
            F.when(none("cover_path") & ~none("keep_cover_path"), F.lit(K.DROP_COVER)),
        )
    )
    return ranked_members.filter("rank > 1").join(keep, "group_id").withColumn("removal_reasons", reasons)


def removal_plan(ranked_members: DataFrame) -> DataFrame:
    """One row per file that automatic dedup deletes, with the file that stays."""
    keep = ranked_members.filter("rank = 1").select("group_id", F.col("file_path").alias("kept_path"))
    return ranked_members.filter("rank > 1").join(keep, "group_id").select("group_id", "ord", "file_path", "kept_path", "file_size")
