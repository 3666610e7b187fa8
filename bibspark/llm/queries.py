"""Thin queries over the operators of this subpackage, each on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, langid, lines, mixing, oracles, pii, quality, secrets, simhash, suffix, tokens, trie, warc
from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.limits_report(tokens.length_histogram(read(spark, sf_dir, "documents")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


#: Session setting that holds the secret key of op4. The tables here are invented, so that the query has a key to show where none is set.
PII_KEY, SHOWN_KEY = "spark.bibspark.pii.key", "key of invented data"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, SHOWN_KEY))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(read(spark, sf_dir, "documents")).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"), least=1)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


#: Conversations take up to 8 turns of the first of each five (fixed values of the query).
BRANCHES, MOST_TAKEN = 5, 8


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    nodes, ends = trie.branched_trie(read(spark, sf_dir, "conversations"), conv - conv % BRANCHES, F.crc32(conv.cast("string").cast("binary")) % (MOST_TAKEN + 1), MOST_TAKEN)
    found = nodes.join(trie.ends_digest(ends), "name", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(trie.NOTHING)).alias("ends_sha256")
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read(spark, sf_dir, "documents"))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), warc.fresh_folder(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_secret_scan,
        op2_token_counts,
        op3_simhash_near_dedup,
        op4_pii_pseudonyms,
        op5_source_mixing,
        op6_language_id,
        op7_suffix_dedup,
        op8_line_dedup,
        op9_decontamination,
        op10_quality_rules,
        op11_conversation_trie,
        op12_token_alignment,
        op13_warc_round_trip,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_decontamination": oracles.leaks_sql(),
        "op10_quality_rules": oracles.quality_sql(),
        "op11_conversation_trie": oracles.trie_sql(),
        "op13_warc_round_trip": oracles.warc_sql(),
    }
