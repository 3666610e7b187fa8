"""Rule-based verification of candidate pairs, as struct-valued expressions over a pair frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

STRICT_AUTHOR, FAIR_AUTHOR, FAIR_TITLE = 0.85, 0.65, 0.60


def pseudonym_match(a: Column, b: Column) -> Column:
    """Equal cleaned names (two empty ones too), or names of one known person."""
    person = {name: i for i, names in enumerate(K.PSEUDONYMS) for name in names}
    lookup = F.create_map(*(F.lit(x) for pair in person.items() for x in pair))
    known = lambda name: F.try_element_at(lookup, name)
    return (a == b) | F.coalesce(known(a) == known(b), F.lit(False))


def suspicious_pair(raw_a: Column, raw_b: Column, form_a: Column, form_b: Column) -> Column:
    """A listed pair of different people in either form and order, or a two-character name inside one of three."""

    def listed(a: Column, b: Column) -> Column:
        pairs = {*K.SUSPICIOUS_PAIRS, *((y, x) for x, y in K.SUSPICIOUS_PAIRS)}
        return F.concat_ws("|", a, b).isin(["|".join(p) for p in sorted(pairs)])

    own_a, own_b = (F.regexp_replace(x, "[^\\x{4e00}-\\x{9fff}]", "") for x in (form_a, form_b))
    inside = lambda short, long: (F.length(short) == 2) & (F.length(long) == 3) & F.contains(long, short)
    return (form_a != form_b) & (listed(raw_a, raw_b) | listed(form_a, form_b) | inside(own_a, own_b) | inside(own_b, own_a))


def author_ok(score: Column, raw_a: Column, raw_b: Column) -> Column:
    n_a, n_b = (F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "[^\\x{4e00}-\\x{9fff}]", "")) for x in (raw_a, raw_b))
    return (score >= STRICT_AUTHOR) | (score >= FAIR_AUTHOR) & ((n_a == n_b) & (n_a >= 2) | (n_a >= 3) & (n_b >= 3))


def title_ok(score: Column) -> Column:
    return score >= FAIR_TITLE


def overall(author: Column, title: Column, isbn_a: Column, isbn_b: Column) -> Column:
    both = (isbn_a != "") & (isbn_b != "")
    return F.when(both, F.when(isbn_a == isbn_b, 1.0).otherwise(0.0)).otherwise(0.60 * author + 0.40 * title)


def decision(author: Column, title_fits: Column, author_fits: Column, total: Column) -> Column:
    """The ladder: the first rule that applies decides."""
    rules = [
        (author < 0.40, False),
        (~author_fits & (author < 0.55), False),
        ((total >= 0.80) & author_fits & title_fits, True),
        ((total >= 0.75) & author_fits, True),
        ((total >= 0.85) & title_fits & (author >= 0.65), True),
        (total < 0.65, False),
        (~author_fits, False),
    ]
    first, *rest = rules
    return reduce(lambda c, r: c.when(r[0], r[1]), rest, F.when(*first)).otherwise(total >= 0.72)


def _percent(x: Column) -> Column:
    return F.bround(x * 100, 0).cast("int").cast("string")


def _say(template: str, x: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), _percent(x), F.lit(after))


def verified(pairs: DataFrame, a: str = "a_", b: str = "b_", author_score: str = "author_ab", title_score: str = "title_ab") -> DataFrame:
    """``pairs`` plus ``verdict``: struct(is_same_book, author_confidence, title_confidence, overall_confidence, reasons, severity).

    The books' columns begin with ``a`` and ``b``: author, author_clean, author_form, isbn_normalized. Scores are of a against b. Each step is a
    column of its own, so that no expression is built into the next ones over and over.
    """
    c = F.col
    isbn_a, isbn_b = c(f"{a}isbn_normalized"), c(f"{b}isbn_normalized")
    forms = [c(f"{side}{name}") for name in ("author_clean", "author_form") for side in (a, b)]
    steps = pairs.withColumns({"__known": pseudonym_match(*forms[:2]), "__odd": suspicious_pair(*forms)})
    alike = F.when(c("__known"), F.greatest(c(author_score), F.lit(1.0))).otherwise(c(author_score))
    steps = steps.withColumn("__author", F.when(c("__odd"), alike * 0.35).otherwise(alike))
    steps = steps.withColumns(
        {
            "__author_ok": author_ok(c("__author"), c(f"{a}author"), c(f"{b}author")),
            "__title_ok": title_ok(c(title_score)),
            "__total": overall(c("__author"), c(title_score), isbn_a, isbn_b),
        }
    )
    steps = steps.withColumn("__same", decision(c("__author"), c("__title_ok"), c("__author_ok"), c("__total")))
    reasons = F.array_compact(
        F.array(
            F.when(~c("__same") & (c("__author") < 0.30), F.lit(K.REASON_OTHER_AUTHOR)),
            F.when(c("__known"), F.lit(K.REASON_PSEUDONYM)),
            F.when(c("__odd"), _say(K.REASON_SUSPICIOUS, c("__author"))),
            F.when(c("__author_ok"), _say(K.REASON_AUTHOR_OK, c("__author"))).otherwise(_say(K.REASON_AUTHOR_BAD, c("__author"))),
            F.when(c("__title_ok"), _say(K.REASON_TITLE_OK, c(title_score))).otherwise(_say(K.REASON_TITLE_BAD, c(title_score))),
        )
    )
    severity = F.when(c("__total") >= 0.9, "high").when(c("__total") >= 0.7, "medium").otherwise("low")

    def result(*values: Column) -> Column:
        names = ("is_same_book", "author_confidence", "title_confidence", "overall_confidence", "reasons", "severity")
        return F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))

    one = F.lit(1.0)
    exact = result(F.lit(True), one, one, one, F.array(F.lit(K.REASON_SAME_ISBN)), F.lit("high"))
    other = result(c("__same"), c("__author"), c(title_score), c("__total"), reasons, severity)
    out = steps.withColumn("verdict", F.when((isbn_a != "") & (isbn_a == isbn_b), exact).otherwise(other))
    return out.drop("__known", "__odd", "__author", "__author_ok", "__title_ok", "__total", "__same")


def may_match(pairs: DataFrame, author_ab: str = "author_ab", author_ba: str = "author_ba") -> DataFrame:
    """``pairs`` plus ``may_match``: whether verified() can match the books in one of both orders, whatever their titles. A title score of 1 is the best case of each rule."""
    best = verified(pairs.withColumn("__best", F.lit(1.0)), author_score=author_ab, title_score="__best").withColumn("__ab", F.col("verdict.is_same_book")).drop("verdict")
    best = verified(best, "b_", "a_", author_ba, "__best").withColumn("may_match", F.col("__ab") | F.col("verdict.is_same_book"))
    return best.drop("__best", "__ab", "verdict")


def size_compatible(size_a: Column, size_b: Column, format_a: Column, format_b: Column, tolerance: float = 0.05) -> Column:
    gap = F.abs(size_a - size_b) / F.greatest(size_a, size_b)
    return (size_a == 0) | (size_b == 0) | (gap < 0.3) | (format_a != format_b) | (gap < tolerance)
