"""Similarities as column expressions: native where SQL can say it, Arrow functions for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from . import kernels
from .fingerprint import simhash_similarity
from .text import fold_chars, nfkc_text


def jaccard(a: Column, b: Column) -> Column:
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def grams(text: Column, n: int) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1))), lambda i: F.substr(bare, i, F.lit(n))))


def ngram(a: Column, b: Column, n: int) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard(grams(a, n), grams(b, n)))


def _pairwise(kernel):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


seq_ratio, combined, author, title = map(_pairwise, (kernels.ratio, kernels.combined, kernels.author, kernels.title))
#: Exact from 0.40 on, else 0: under that no pair is ever accepted.
title_from_040 = _pairwise(kernels.title_from(0.40))
cjk_author, western_author = map(_pairwise, (kernels.cjk_author, kernels.western_author))


def isbn_score(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


def size_score(size_a: Column, size_b: Column, format_a: Column, format_b: Column) -> Column:
    share = F.least(size_a, size_b) / F.greatest(size_a, size_b)
    other = (format_a != "") & (format_b != "") & (F.lower(format_a) != F.lower(format_b))
    return F.when((size_a == 0) | (size_b == 0), 0.5).when(other, F.least(share + 0.15, F.lit(1.0))).otherwise(share)


def weights(isbns: bool, hashes: bool) -> dict[str, float]:
    """Weights of the scores in their order. What is missing on a side gives its weight to other scores."""
    w = dict(K.OVERALL_WEIGHTS)
    if not isbns:
        for name, share in (("simhash", 0.25), ("title", 0.15), ("author", 0.60)):
            w[name] += w["isbn"] * share
        w["isbn"] = 0.0
    if not hashes:
        for name, share in (("title", 0.25), ("author", 0.60), ("size", 0.15)):
            w[name] += w["simhash"] * share
        w["simhash"] = 0.0
    return w


def cap(isbn: Column, author: Column, title: Column, both_authors: Column) -> Column:
    """The most that the overall similarity can be, whatever the other scores."""
    by_author = F.when(isbn >= 0.5, 1.0).when(author < 0.35, 0.25).when(author < 0.55, 0.45).when(author < 0.70, 0.65).otherwise(1.0)
    return F.least(F.when(both_authors, 1.0).otherwise(0.25), by_author, F.when(title < 0.4, 0.35).otherwise(1.0))


def uncapped(scores: dict[str, Column], both_isbns: Column, both_hashes: Column) -> Column:
    """Weighted mean of isbn, author, title, simhash and size scores, added up in this order."""

    def mean(isbns: bool, hashes: bool) -> Column:
        w = weights(isbns, hashes)
        weighted = F.lit(0.0)
        for name in w:
            weighted = weighted + scores[name] * F.lit(w[name])
        return weighted / F.lit(sum(w.values()))

    return F.when(both_isbns, F.when(both_hashes, mean(True, True)).otherwise(mean(True, False))).otherwise(F.when(both_hashes, mean(False, True)).otherwise(mean(False, False)))


def overall(scores: dict[str, Column], both_isbns: Column, both_hashes: Column, both_authors: Column) -> Column:
    """Weighted mean of isbn, author, title, simhash and size scores, under caps; compared unrounded."""
    return F.least(uncapped(scores, both_isbns, both_hashes), cap(scores["isbn"], scores["author"], scores["title"], both_authors))


def pair_overall(a: str, b: str, author_score: Column, title_score: Column) -> Column:
    """overall() of a pair frame whose books' columns begin with ``a`` and ``b``."""
    c = lambda side, name: F.col(f"{side}{name}")
    scores = {
        "isbn": isbn_score(c(a, "isbn_normalized"), c(b, "isbn_normalized")),
        "author": author_score,
        "title": title_score,
        "simhash": simhash_similarity(c(a, "simhash"), c(b, "simhash")),
        "size": size_score(c(a, "file_size"), c(b, "file_size"), c(a, "file_format"), c(b, "file_format")),
    }
    both = lambda name, none: (c(a, name) != none) & (c(b, name) != none)
    return overall(scores, both("isbn_normalized", ""), both("simhash", 0), both("author", ""))


def register(spark: SparkSession) -> None:
    """SQL names for the kernels."""
    for name, udf in (("seq_ratio", seq_ratio), ("combined_sim", combined), ("author_sim", author), ("title_sim", title)):
        spark.udf.register(name, udf)

    def arrow(kernel):
        @F.pandas_udf(T.StringType())
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(kernel, na_action="ignore")

        return run

    spark.udf.register("nfkc", arrow(nfkc_text))
    spark.udf.register("fold_text", arrow(fold_chars))
