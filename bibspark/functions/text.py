"""Text normalisation (native, but for Unicode compatibility forms) and the same expressions as DuckDB SQL."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

CJK = "[\\x{4e00}-\\x{9fff}]"
#: The same class is read by Java and by RE2.
PUNCTUATION = "[" + "".join("\\" + c if ord(c) < 128 else c for c in K.PUNCTUATION) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


# ---------------------------------------------------------------- kernels
def nfkc_text(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def fold_chars(text: str) -> str:
    """NFKC; CJK ideographs and ASCII stay, of anything else the ASCII part of its decomposition."""
    out = []
    for c in unicodedata.normalize("NFKC", text):
        if c < "\x80" or "一" <= c <= "鿿":
            out.append(c)
        else:
            out += [d for d in unicodedata.normalize("NFKD", c) if d < "\x80"]
    return "".join(out)


def _arrow(kernel):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(kernel, na_action="ignore")

    return run


_nfkc, _fold = _arrow(nfkc_text), _arrow(fold_chars)


def _only_where(udf, text: Column, needed: str) -> Column:
    """Python sees only the texts that a rule needs; all others travel as null."""
    odd = text.rlike(needed)
    return F.when(odd, udf(F.when(odd, text))).otherwise(text)


def nfkc(text: Column) -> Column:
    return _only_where(_nfkc, text, "[^\\x00-\\x7F\\x{4e00}-\\x{9fff}]")


def fold(text: Column) -> Column:
    return _only_where(_fold, text, "[^\\x00-\\x7F\\x{4e00}-\\x{9fff}]")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def sql_squeeze(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def clean_text(text: Column) -> Column:
    return squeeze(nfkc(F.coalesce(text, F.lit(""))))


def remove_punctuation(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, PUNCTUATION, " "))


def sql_remove_punctuation(text: str) -> str:
    return sql_squeeze(f"regexp_replace({text}, {quoted(PUNCTUATION)}, ' ', 'g')")


def _without(text: Column, words: list[str]) -> Column:
    return reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("")), K.longest_first(words), text)


def sql_without(text: str, words: list[str]) -> str:
    return reduce(lambda t, w: f"replace({t}, {quoted(w)}, '')", K.longest_first(words), text)


# ---------------------------------------------------------------- normal forms
_STOP = sorted({*K.ENGLISH_STOPWORDS, *K.ROMANCE_STOPWORDS})


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_general(text: Column, author: bool = False) -> Column:
    def form(folded: Column) -> Column:
        plain = F.regexp_replace(F.lower(F.regexp_replace(folded, CJK, "")), "[^a-z0-9]+", " ")
        words = F.array_sort(F.filter(F.split(plain, " "), lambda w: (F.length(w) > 1) & ~w.isin(_STOP)))
        ideographs = F.regexp_replace(folded, "[^\\x{4e00}-\\x{9fff}]", "")
        if author:
            rest = F.filter(F.array(ideographs), lambda w: w != "")
        else:
            kept = F.regexp_extract_all(_without(ideographs, K.CJK_STOP_WORDS), F.lit(f"({CJK})"), F.lit(1))
            rest = F.when(ideographs == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.filter(kept, lambda c: ~c.isin(K.CJK_STOP_CHARS))))
        return F.array_join(F.concat(words, rest), " ")

    return let(fold(F.coalesce(text, F.lit(""))), form)


def sql_normalize_general(text: str, author: bool = False) -> str:
    folded = rf"regexp_replace(strip_accents(coalesce({text}, '')), '[^\x00-\x7F\x{{4e00}}-\x{{9fff}}]', '', 'g')"
    words = rf"string_split(regexp_replace(lower(regexp_replace({folded}, '{CJK}', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    words = f"list_sort(list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({sql_list(_STOP)}, w)))"
    ideographs = rf"regexp_replace({folded}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')"
    if author:
        rest = f"list_filter([{ideographs}], lambda w: w <> '')"
    else:
        rest = f"list_sort(list_filter(string_split({sql_without(ideographs, K.CJK_STOP_WORDS)}, ''), lambda c: c <> '' AND NOT list_contains({sql_list(K.CJK_STOP_CHARS)}, c)))"
    return f"array_to_string(list_concat({words}, {rest}), ' ')"


def normalize_title(title: Column) -> Column:
    return normalize_general(_without(remove_punctuation(F.coalesce(title, F.lit(""))), K.TITLE_SUFFIXES))


def sql_normalize_title(title: str) -> str:
    return sql_normalize_general(sql_without(sql_remove_punctuation(f"coalesce({title}, '')"), K.TITLE_SUFFIXES))


def normalize_author(author: Column) -> Column:
    def first(name: Column) -> Column:
        out = name
        for mark in reversed(K.AUTHOR_SEPARATORS):
            out = F.when(F.contains(name, F.lit(mark)), F.split_part(name, F.lit(mark), F.lit(1))).otherwise(out)
        return out

    return normalize_general(let(_without(remove_punctuation(F.coalesce(author, F.lit(""))), K.AUTHOR_ROLES), first), author=True)


def sql_normalize_author(author: str) -> str:
    name = sql_without(sql_remove_punctuation(f"coalesce({author}, '')"), K.AUTHOR_ROLES)
    cases = " ".join(f"WHEN contains({name}, {quoted(m)}) THEN split_part({name}, {quoted(m)}, 1)" for m in K.AUTHOR_SEPARATORS)
    return sql_normalize_general(f"CASE {cases} ELSE {name} END", author=True)


# ---------------------------------------------------------------- small helpers
def human_size(size: Column) -> Column:
    """1024-based size with one decimal, half to even."""
    out, value = None, size.cast("decimal(38,18)")
    steps = [(unit, F.bround(value / (1024**k), 1)) for k, unit in enumerate(["B", "KB", "MB", "GB", "TB"])]
    for k, (unit, v) in reversed(list(enumerate(steps))):
        own = F.concat(F.format_string("%.1f", v.cast("double")), F.lit(" " + unit))
        out = own if out is None else F.when(size < 1024 ** (k + 1), own).otherwise(out)
    return out


def html_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; a name that is only an extension has none."""
    return F.lower(F.regexp_extract(file_name(path), "^.+(\\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike("^.+\\.[^.]+$"), F.regexp_extract(name, "^(.+)\\.[^.]+$", 1)).otherwise(name)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "\\s+", " "))


def clean_pdf_field(text: Column) -> Column:
    """Leading slash, then one date mark, go; Latin-1 that is really UTF-8 is decoded again; trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, "^/", ""), "^[Dd]:", "")
    raw = F.encode(bare, "ISO-8859-1")
    twice = bare.rlike("[^\\x00-\\x7F]") & ~bare.rlike("[^\\x00-\\xFF]") & F.is_valid_utf8(raw.cast("string"))
    return F.trim(F.when(twice, raw.cast("string")).otherwise(bare))


def online_author(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[\\[\\]]", ""), "\\s*/\\s*", ", ")


def label_field(text: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(text, f"{label}\\s*[:：]\\s*([^\\n]+)", 1))


def meta_parts(text: Column) -> tuple[Column, Column, Column]:
    """(author, publisher, publish_date) of a text with parts between slashes: four digits make a date and a publisher's word a publisher (the
    last of each counts), the first other part is the author."""
    parts = F.filter(F.transform(F.split(text, "/"), lambda p: F.trim(p)), lambda p: p != "")
    date = lambda p: p.rlike("^[0-9]{4}")
    house = lambda p: p.rlike("出版社|出版|Publish")
    pick = lambda rule, at: F.coalesce(F.try_element_at(F.filter(parts, rule), F.lit(at)), F.lit(""))
    return pick(lambda p: ~date(p) & ~house(p), 1), pick(lambda p: ~date(p) & house(p), -1), pick(date, -1)
