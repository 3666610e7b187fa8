"""ISBN normalisation, native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weighted(digits: Column) -> Column:
    """Sum of the first twelve digits, every second one thrice."""
    terms = [F.substring(digits, k + 1, 1).try_cast("int") * (3 if k % 2 else 1) for k in range(12)]
    return reduce(lambda a, b: a + b, terms)


def sql_weighted(digits: str) -> str:
    return "(" + " + ".join(f"TRY_CAST(substr({digits}, {k + 1}, 1) AS INT) * {3 if k % 2 else 1}" for k in range(12)) + ")"


def isbn10_to_isbn13(isbn: Column) -> Column:
    """'' unless ten characters of which the first nine are digits; the old check digit is not looked at."""
    body = F.concat(F.lit("978"), F.substring(isbn, 1, 9))
    check = F.pmod(10 - F.pmod(_weighted(body), F.lit(10)), F.lit(10))
    return F.when((F.length(isbn) == 10) & isbn.rlike("^[0-9]{9}"), F.concat(body, check.cast("string"))).otherwise("")


def sql_isbn10_to_isbn13(isbn: str) -> str:
    body = f"concat('978', substr({isbn}, 1, 9))"
    return f"CASE WHEN length({isbn}) = 10 AND regexp_matches({isbn}, '^[0-9]{{9}}') THEN concat({body}, CAST((10 - {sql_weighted(body)} % 10) % 10 AS VARCHAR)) ELSE '' END"


def is_isbn13(isbn: Column) -> Column:
    right = F.pmod(_weighted(isbn) + F.substring(isbn, 13, 1).try_cast("int"), F.lit(10)) == 0
    return F.coalesce(isbn.rlike("^[0-9]{13}$") & right, F.lit(False))


def sql_is_isbn13(isbn: str) -> str:
    return f"coalesce(regexp_matches({isbn}, '^[0-9]{{13}}$') AND ({sql_weighted(isbn)} + TRY_CAST(substr({isbn}, 13, 1) AS INT)) % 10 = 0, false)"


def bare_isbn(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9Xx]", ""))


def normalize_isbn(text: Column) -> Column:
    bare = bare_isbn(text)
    return F.when(F.length(bare) == 10, isbn10_to_isbn13(bare)).when((F.length(bare) == 13) & is_isbn13(bare), bare).otherwise("")


def sql_normalize_isbn(text: str) -> str:
    bare = f"upper(regexp_replace(coalesce({text}, ''), '[^0-9Xx]', '', 'g'))"
    return f"CASE WHEN length({bare}) = 10 THEN {sql_isbn10_to_isbn13(bare)} WHEN length({bare}) = 13 AND {sql_is_isbn13(bare)} THEN {bare} ELSE '' END"


def query_isbn(text: Column) -> Column:
    return F.regexp_replace(text, "[-\\s]", "")
