"""Exact length histogram of encoded documents.

Documents are encoded once with a public tokenizer; what leaves each Arrow batch is only the count
of documents per encoded length. Sums over the histogram answer totals, quantiles and the tokens
that survive truncation for every context limit at once, without touching a document again.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: The vocabulary's public pre-tokenization pattern, and its usual place.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern's white space (Unicode property White_Space). Longer runs than LONG_GAP are encoded by themselves: the pattern tries
#: them backwards, one level of its stack per character.
_GAP, LONG_GAP = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]", 1 << 16
#: Lengths per block of the two-level sums.
BLOCK = 1024


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """Encoder of a rank file; once per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Number of tokens of a text. A run of white space is one piece of the pattern but for its last character, which goes with what follows;
    so a long run can be encoded apart, with the same tokens."""
    encode = encoder(vocabulary, pattern).encode_ordinary
    if len(text) <= LONG_GAP:
        return len(encode(text))
    total, at = 0, 0
    for m in re.finditer(f"{_GAP}{{{LONG_GAP},}}", text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encode(text[at : m.start()])) + len(encoder(vocabulary, r"\s+").encode_ordinary(text[m.start() : stop]))
        at = stop
    return total + len(encode(text[at:]))


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many documents have which encoded length, whole texts; null and empty texts have 0 tokens.

    Repeated rows count each; ties are documents of one length. An empty table gives an empty histogram. Texts of any length are encoded whole,
    one at a time. Other columns are ignored, whatever their names. ``vocabulary`` is a rank file at the same path on every machine.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                own = text.as_py()
                counts[encoded_length(own, vocabulary, pattern) if own else 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["n_tokens", "n_docs"])

    return docs.select(text_col).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits_report(histogram: DataFrame) -> DataFrame:
    """For every occurring length L as a context limit: documents and tokens at or above it, totals, truncated total, and rank.

    Columns: n_tokens (= L), n_docs, docs_ge, tokens_ge, docs_total, tokens_total, truncated_total (sum of min(length, L)),
    docs_cut (longer than L), quantile (share of documents with at most L tokens). The sums run in two levels, over blocks of
    lengths and inside each block, so that no task sees the whole histogram.
    """
    n, d = F.col("n_tokens"), F.col("n_docs")
    held = checkpointed(histogram).withColumn("block", F.floor(n / BLOCK))
    blocks = held.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(n * d).alias("b_tokens"))
    after, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("b_docs", "b_tokens")),
        *(F.sum(c).over(every).alias(t) for c, t in (("b_docs", "docs_total"), ("b_tokens", "tokens_total"))),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.select("block", "n_tokens", "n_docs", F.sum(d).over(inside).alias("docs_in"), F.sum(n * d).over(inside).alias("tokens_in"))
    docs_ge, tokens_ge = F.col("docs_in") + F.col("b_docs_after"), F.col("tokens_in") + F.col("b_tokens_after")
    return (
        sums.join(blocks, "block")
        .select("n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), "docs_total", "tokens_total")
        .withColumn("docs_cut", F.col("docs_ge") - d)
        .withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_ge") + n * F.col("docs_ge"))
        .withColumn("quantile", (F.col("docs_total") - F.col("docs_cut")) / F.col("docs_total"))
    )


def truncated_totals(report: DataFrame, limits: DataFrame, limit_col: str = "context_limit") -> DataFrame:
    """(context_limit, docs_cut, truncated_total) for any limits, occurring as a length or not.

    Limits and lengths are put in one order, block by block, and each limit takes the next length above it: no join by inequality.
    """
    total = report.agg(F.max("tokens_total")).first()[0] or 0
    own = limits.select(F.col(limit_col).cast("long").alias("at")).filter(F.col("at").isNotNull()).distinct()
    none = F.lit(None).cast("struct<docs_ge:bigint,tokens_ge:bigint>")
    both = own.select("at", F.lit(1).alias("limit"), none.alias("s")).unionByName(report.select(F.col("n_tokens").alias("at"), F.lit(0).alias("limit"), F.struct("docs_ge", "tokens_ge").alias("s")))
    both = both.withColumn("block", F.floor(F.col("at") / BLOCK))
    heads = both.groupBy("block").agg(F.min_by("s", F.when(F.col("limit") == 0, F.col("at"))).alias("head"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.select("block", F.first("head", ignorenulls=True).over(later).alias("next"))
    inside = Window.partitionBy("block").orderBy("at", "limit").rowsBetween(1, Window.unboundedFollowing)
    met = both.withColumn("s", F.when(F.col("limit") == 1, F.first("s", ignorenulls=True).over(inside))).filter("limit = 1").join(heads, "block")
    met = met.select("at", F.coalesce("s", "next").alias("s"))
    cut, over = F.coalesce("s.docs_ge", F.lit(0)), F.coalesce("s.tokens_ge", F.lit(0))
    return met.select(F.col("at").alias(limit_col), cut.alias("docs_cut"), (F.lit(total) - over + F.col("at") * cut).alias("truncated_total"))


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of the documents does not exceed."""
    picks = [F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    return report.agg(*picks).select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)))).alias("x")).select("x.*")
