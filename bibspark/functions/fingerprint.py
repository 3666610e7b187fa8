"""Keys and 64-bit SimHash, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import isbn, text

COMPLETENESS = ["title", "author", "publisher", "publish_date", "isbn", "language", "description"]


def title_key(title: Column) -> Column:
    return F.md5(text.normalize_title(title))


def author_key(author: Column) -> Column:
    return F.md5(text.normalize_author(author))


def title_author_key(title_key: Column, author_key: Column) -> Column:
    return F.md5(F.concat(title_key, F.lit("|"), author_key))


def size_hash(size: Column, path: Column) -> Column:
    return F.when(path != "", F.md5(F.concat(size.cast("string"), F.lit("|"), F.lower(text.file_name(path))))).otherwise("")


def completeness(columns: list[str] = COMPLETENESS) -> Column:
    """Share of the seven descriptive fields that are not blank."""
    filled = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0) for c in columns]
    return sum(filled[1:], filled[0]) / F.lit(float(len(columns)))


def _ideograph_grams(low: Column) -> Column:
    """Bigrams and trigrams of the ideographs of a text run together, none with a stopword; null where it has none."""
    run = F.regexp_replace(low, "[^\\x{4e00}-\\x{9fff}]", "")
    stop = "[" + "".join(K.SIMHASH_STOP_CHARS) + "]"

    def grams(n: int) -> Column:
        own = F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substr(run, i, F.lit(n))))
        return F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda g: ~g.rlike(stop))

    return F.when(run != "", F.concat(grams(2), grams(3)))


def _is_word(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(K.SIMHASH_STOPWORDS)


def tokens(content: Column) -> Column:
    """Latin words of two letters or more, and bigrams and trigrams of the ideographs run together; none with a stopword."""
    low = F.lower(F.coalesce(content, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)), _is_word)
    return F.concat(words, F.coalesce(_ideograph_grams(low), F.array().cast("array<string>")))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) of every occurrence of tokens(); words are told from others after they have become rows, where that is compiled code."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = docs.select(id_col, F.explode(F.split(low, "[^a-z]+")).alias("token")).filter(_is_word(F.col("token")))
    ideographs = docs.filter(F.col(text_col).rlike("[\\x{4e00}-\\x{9fff}]")).select(id_col, F.explode(_ideograph_grams(low)).alias("token"))
    return held.unionByName(ideographs)


def token_hash(token: Column) -> Column:
    """First 64 bits of SHA-1, as a signed bit pattern."""
    return F.conv(F.substring(F.sha1(token), 1, 16), 16, -10).cast("bigint")


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n)."""
    return occurrences(docs, id_col, text_col).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def simhashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, simhash) of rows that have a token: one partially aggregated pass over (id, token) occurrences.

    Occurrences carry the same sign as token weights, so tokens need no count of their own before the sums. Bits are counted two at a time, bit k in
    the lower and bit k + 32 in the upper half of one sum.
    """
    rows = occurrences(docs, id_col, text_col).select(id_col, token_hash(F.col("token")).alias("h"))
    pairs = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1 << 32 | 1))).alias(f"s{k}") for k in range(32)]
    ones = [F.col(f"s{k}").bitwiseAND(F.lit((1 << 32) - 1)) for k in range(32)] + [F.shiftrightunsigned(f"s{k}", 32) for k in range(32)]
    bits = [F.when(2 * ones[i] > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    while len(bits) > 1:
        bits = [bits[k].bitwiseOR(bits[k + 1]) for k in range(0, len(bits), 2)]
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), *pairs).select(id_col, bits[0].cast("long").alias("simhash"))


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0.0).otherwise(1.0 - hamming(a, b) / 64.0)


def with_fingerprints(books: DataFrame) -> DataFrame:
    """``books`` plus isbn_normalized, author_clean, author_form, title_key, author_key, title_author_key, size_hash, text_preview, simhash, metadata_completeness."""
    keyed = books.withColumns(
        {
            "isbn_normalized": isbn.normalize_isbn(F.col("isbn")),
            "author_clean": text.clean_text(F.col("author")),
            "author_form": text.normalize_author(F.col("author")),
            "title_key": title_key(F.col("title")),
            "size_hash": size_hash(F.col("file_size"), F.col("file_path")),
            "text_preview": F.substring(F.coalesce("lead_text", F.lit("")), 1, 200),
            "metadata_completeness": completeness(),
        }
    )
    keyed = keyed.withColumn("author_key", F.md5("author_form")).withColumn("title_author_key", title_author_key(F.col("title_key"), F.col("author_key")))
    return keyed.join(simhashes(books.select("ord", F.substring("lead_text", 1, 1000).alias("lead_text")), "ord", "lead_text"), "ord", "left").withColumn("simhash", F.coalesce("simhash", F.lit(0)))
