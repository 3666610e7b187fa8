"""Scalar kernels behind the Arrow functions: what no built-in can express (Ratcliff-Obershelp ratio and what is mixed from it).

Results are memoised per worker, as names and titles repeat massively; the caches are bounded.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

from .. import constants as K
from .text import fold_chars, nfkc_text

MEMO = 1 << 12
_PUNCTUATION = re.compile("[" + "".join(map(re.escape, K.PUNCTUATION)) + "]")
_GENERAL_STOP = {*K.ENGLISH_STOPWORDS, *K.ROMANCE_STOPWORDS}
_STOP_CHARS = set(K.CJK_STOP_CHARS)


@lru_cache(MEMO)
def ideographs(text: str) -> str:
    return "".join(c for c in text if "一" <= c <= "鿿")


@lru_cache(MEMO)
def clean(text: str) -> str:
    return " ".join(nfkc_text(text).split())


def _cut(text: str, words: list[str]) -> str:
    for word in K.longest_first(words):
        text = text.replace(word, "")
    return text


def _general(text: str, author: bool) -> str:
    folded = fold_chars(text)
    own = ideographs(folded)
    words = sorted(w for w in re.findall("[a-z0-9]+", re.sub("[一-鿿]", "", folded).lower()) if len(w) > 1 and w not in _GENERAL_STOP)
    if author:
        return " ".join([*words, own] if own else words)
    return " ".join([*words, *sorted(c for c in _cut(own, K.CJK_STOP_WORDS) if c not in _STOP_CHARS)])


@lru_cache(MEMO)
def general(text: str) -> str:
    return _general(text, False)


@lru_cache(MEMO)
def title_form(text: str) -> str:
    return _general(_cut(" ".join(_PUNCTUATION.sub(" ", text).split()), K.TITLE_SUFFIXES), False)


@lru_cache(MEMO)
def author_form(text: str) -> str:
    name = _cut(" ".join(_PUNCTUATION.sub(" ", text).split()), K.AUTHOR_ROLES)
    mark = next((m for m in K.AUTHOR_SEPARATORS if m in name), None)
    return _general(name.split(mark)[0] if mark else name, True)


@lru_cache(MEMO)
def general_words(text: str) -> frozenset[str]:
    return frozenset(general(text).split())


# ---------------------------------------------------------------- similarity
def jaccard(a: set | frozenset, b: set | frozenset) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


@lru_cache(1 << 10)
def grams(text: str, n: int) -> frozenset[str]:
    text = text.replace(" ", "")
    return frozenset(text[i : i + n] for i in range(max(len(text) - n, 0) + 1))


def ngram(a: str, b: str, n: int) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else jaccard(grams(a, n), grams(b, n))


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; its value depends on the order of the arguments."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@lru_cache(MEMO)
def combined(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    ga, gb = general(a), general(b)
    if ga and ga == gb:
        return 0.98
    ca, cb = clean(a), clean(b)
    mixed = 0.30 * ratio(ca, cb) + 0.25 * ngram(ca, cb, 2) + 0.30 * ngram(ca, cb, 3) + 0.15 * jaccard(set(ga.split()), set(gb.split()))
    return mixed / (0.30 + 0.25 + 0.30 + 0.15)


def _name_tokens(name: str) -> list[str]:
    return [w for w in re.sub(r"[^a-zA-Z\s]", " ", name.lower()).split() if len(w) > 1]


def western_author(a: str, b: str) -> float:
    ta, tb = _name_tokens(a), _name_tokens(b)
    if not ta or not tb:
        return combined(a, b)
    given = combined(" ".join(ta[:-1]), " ".join(tb[:-1])) if len(ta) > 1 and len(tb) > 1 else 0.0
    ia, ib = {w[0] for w in ta[:-1]}, {w[0] for w in tb[:-1]}
    initials = len(ia & ib) / len(ia | ib) if ia and ib else 0.0
    return 0.50 * float(ta[-1] == tb[-1]) + 0.30 * given + 0.20 * initials


def cjk_author(a: str, b: str) -> float:
    a, b = ideographs(a), ideographs(b)
    sizes = {len(a), len(b)}
    if a == b and sizes <= {1, 2, 3}:
        return 1.0
    if sizes == {1}:
        return 0.0
    if sizes == {2}:
        return 0.25 if a[0] == b[0] else 0.15 if a[1] == b[1] else 0.0
    if sizes == {3}:
        if a[0] == b[0]:
            return 0.6 if a[1] == b[1] else 0.25
        return 0.35 if a[1:] == b[1:] else ngram(a, b, 2) * 0.5
    shared = len(set(a) & set(b)) / max(len(set(a)), len(set(b)))
    behind = ratio(a[1:], b[1:]) if min(sizes) >= 2 else 0.0
    score = 0.25 * float(a[0] == b[0]) + 0.35 * behind + 0.20 * ratio(a, b) + 0.20 * shared
    return min(score * 0.5 if sizes == {1, 2} else score, 1.0)


@lru_cache(MEMO)
def author(a: str, b: str) -> float:
    if not a or not b:
        return 0.2
    if author_form(a) == author_form(b):
        return 1.0
    ca, cb = clean(a), clean(b)
    if ca == cb:
        return 0.95
    return cjk_author(ca, cb) if ideographs(ca) and ideographs(cb) else western_author(ca, cb)


@lru_cache(MEMO)
def title(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    ca, cb = clean(a), clean(b)
    if ca == cb:
        return 1.0
    fa = title_form(a)
    if fa and fa == title_form(b):
        return 0.98
    ia, ib = ideographs(ca), ideographs(cb)
    if ia and ib:
        return 0.30 * ngram(ca, cb, 2) + 0.25 * ngram(ca, cb, 3) + 0.25 * ratio(ca, cb) + 0.20 * jaccard(set(ia), set(ib))
    return combined(ca, cb)


def title_from(floor: float):
    """title(), or 0.0 where that is under ``floor``: the costly ratio is left out where even a ratio of 1 could not reach it."""

    def kernel(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        ca, cb = clean(a), clean(b)
        fa = title_form(a)
        if ca == cb or fa and fa == title_form(b):
            return title(a, b)
        ia, ib = ideographs(ca), ideographs(cb)
        alike = 2 * min(len(ca), len(cb)) / (len(ca) + len(cb))  # no ratio is larger
        if ia and ib:
            most = 0.30 * ngram(ca, cb, 2) + 0.25 * ngram(ca, cb, 3) + 0.25 * alike + 0.20 * jaccard(set(ia), set(ib))
        elif general(ca) == general(cb):
            most = 1.0
        else:
            most = 0.30 * alike + 0.25 * ngram(ca, cb, 2) + 0.30 * ngram(ca, cb, 3) + 0.15 * jaccard(general_words(ca), general_words(cb))
        if most < floor - 1e-6:
            return 0.0
        value = title(a, b)
        return value if value >= floor else 0.0

    return kernel
