"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass their kind's validation are replaced by the value of a keyed
permutation of exactly the valid values of the same format: a card number becomes another card
number with a right check digit, a date another real date written the same way. Equal values get
equal pseudonyms wherever they occur, so documents stay linked without a lookup table, a shuffle or
any state; whoever has the key can reverse them.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import heapq
import ipaddress
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bounded_batches, column, filled, schema_of

ROUNDS = 10


# ---------------------------------------------------------------- permutation of 0 .. n-1
def _feistel(key: bytes, tweak: str, n: int, x: int, back: bool) -> int:
    """Alternating Feistel network over a grid a*b >= n, walked along its cycle until the value is below n again."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def turn(i: int, half: int, size: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{n}|{i}|{half}".encode(), key=key, digest_size=24).digest()
        return int.from_bytes(digest, "big") % size

    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * turn(i, left, b)) % b
            else:
                left = (left + sign * turn(i, right, a)) % a
        x = left * b + right
        if x < n:
            return x


# ---------------------------------------------------------------- formats
def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return -total % 10


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _by_place(text: str, alphabets: list[str], move: Callable[[int, int], int]) -> str:
    """Permute the characters at the places that have an alphabet ('' keeps the character); mixed-radix rank and back."""
    rank, size = 0, 1
    for c, own in zip(text, alphabets, strict=True):
        if own:
            rank, size = rank * len(own) + own.index(c), size * len(own)
    rank, out = move(size, rank), []
    for c, own in zip(reversed(text), reversed(alphabets), strict=True):
        if own:
            rank, at = divmod(rank, len(own))
            c = own[at]
        out.append(c)
    return "".join(reversed(out))


def _letters(first: int, last: int, of: Callable[[str], bool] = str.isalpha) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if of(c))


#: Letters of other scripts that are permuted among themselves: Latin with accents, Greek, Cyrillic, Hebrew, Arabic, kana, Han, Hangul.
OTHER = (
    *(_letters(a, b, of) for a, b in ((0xC0, 0x17F), (0x391, 0x3C9), (0x400, 0x45F)) for of in (str.islower, str.isupper)),
    *(_letters(a, b) for a, b in ((0x5D0, 0x5EA), (0x627, 0x64A), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))),
)


@lru_cache(maxsize=1 << 12)
def _alphabet(c: str) -> str:
    """The characters among which one is permuted; none for marks and letters of no known script."""
    return next((own for own in (LOWER, UPPER, DIGIT, *OTHER) if c in own), "")


def _classes(text: str, start: int = 0, stop: int | None = None) -> list[str]:
    stop = len(text) if stop is None else stop
    return [_alphabet(c) if start <= i < stop else "" for i, c in enumerate(text)]


def _card(text: str, move: Callable) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or int(digits[-1]) != luhn_digit(digits[:-1]) or len(set(digits)) == 1:
        return None
    payload = _by_place(digits[:-1], [DIGIT] * (len(digits) - 1), move)
    fresh = iter(payload + str(luhn_digit(payload)))
    return "".join(next(fresh) if c.isdigit() else c for c in text)


_LOW, _HIGH = DIGIT[:2], DIGIT[2:]  # North American area and exchange codes begin with 2 to 9


def _phone(text: str, move: Callable) -> str:
    digits = re.sub(r"\D", "", text)
    own = digits[-10:]
    # the exchange 555 marks numbers kept for fiction; the exchange code is kept so that such numbers stay such numbers.
    # An area code that cannot be dialled is as private as another one; it stays of its kind.
    places = [_HIGH if own[0] in _HIGH else _LOW, DIGIT, DIGIT, "", "", "", DIGIT, DIGIT, DIGIT, DIGIT]
    fresh = iter(digits[:-10] + _by_place(own, places, move))
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _world_phone(text: str, move: Callable) -> str | None:
    """+ and a country code (up to the first gap, else two digits), which stay; 8 to 15 digits in all."""
    digits = re.sub(r"\D", "", text)
    lead = re.match(r"\+([0-9]{1,3})(?![0-9])", text)
    code = len(lead.group(1)) if lead else 1 if digits[0] in "17" else 2
    if not 8 <= len(digits) <= 15:
        return None
    if len(digits) == 11 and digits[0] == "1" and code == 1:
        return _phone(text, move)  # the same number in another notation
    own = digits[code:]
    fresh = iter(digits[:code] + _by_place(own, ["0" if own[0] == "0" else DIGIT[1:], *[DIGIT] * (len(own) - 1)], move))
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _ip6(text: str, move: Callable) -> str | None:
    """Digit for digit and letter for letter, so that groups keep their lengths; a group's first digit does not become zero."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if sum(c != ":" for c in text) < 4 or not any(c.isdigit() for c in text):
        return None
    kinds = ["" if c == ":" else DIGIT if c.isdigit() else LOWER[:6] if c.islower() else UPPER[:6] for c in text]
    for i, c in enumerate(text):
        if kinds[i] == DIGIT and (i == 0 or text[i - 1] == ":"):
            kinds[i] = "" if c == "0" else DIGIT[1:]
    return _by_place(text, kinds, move)


def _ip(text: str, move: Callable) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = move(1 << 32, sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)))
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ssn(text: str, move: Callable) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = move(898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(text: str, move: Callable) -> str | None:
    own = re.sub(r"\s", "", text)
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if as_number(own[4:] + own[:4]) % 97 != 1:
        return None
    account = _by_place(own[4:], _classes(own[4:]), move)
    fresh = iter(own[:2] + f"{98 - as_number(account + own[:2] + '00') % 97:02d}" + account)
    return "".join(c if c.isspace() else next(fresh) for c in text)


#: Length of the IBANs of each country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "LC RU",
}


def _iban_form(n: int, countries: str) -> str:
    groups, rest = divmod(n - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


#: What follows an IBAN is not read as part of it: its country says how long it is. Looked for at every place, as a failed one may hide the start of another.
_IBAN = rf"(?<![A-Za-z0-9])(?=({'|'.join(_iban_form(*x) for x in IBAN_LENGTHS.items())})(?![A-Za-z0-9]))"
_OWN_LENGTH = re.compile(_IBAN, re.ASCII)


def _other_iban(text: str, move: Callable) -> str | None:
    """Right check digits, but not of its country's length: stays among values that hold no IBAN of that length at their start."""
    new = _iban(text, move)
    while new and (m := _OWN_LENGTH.match(new)) and _iban(m.group(1), lambda n, x: x):
        new = _iban(new, move)
    return new


YEARS = 1800, 2199
_FIRST, _LAST = datetime.date(YEARS[0], 1, 1).toordinal(), datetime.date(YEARS[1], 12, 31).toordinal()


def _date(year: str, month: str, day: str, move: Callable) -> tuple[str, str, str] | None:
    y, m, d = int(year), int(month), int(day)
    if not YEARS[0] <= y <= YEARS[1] or not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1]:
        return None
    new = datetime.date.fromordinal(_FIRST + move(_LAST - _FIRST + 1, datetime.date(y, m, d).toordinal() - _FIRST))
    return f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"


def _iso_date(text: str, move: Callable) -> str | None:
    new = _date(text[:4], text[5:7], text[8:], move)
    return new and text[4].join(new)


def _day_first(text: str, move: Callable) -> str | None:
    """dd/mm/yyyy, or mm/dd/yyyy where only that is a date; written back in the same order."""
    a, b, y = text[:2], text[3:5], text[6:]
    new = _date(y, b, a, move)
    if new:
        return text[2].join((new[2], new[1], new[0]))
    # month first: stays among dates that cannot be read day first
    new = _date(y, a, b, move)
    while new and int(new[2]) <= 12:
        new = _date(*new, move)
    return new and text[2].join((new[1], new[2], new[0]))


MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])


def _written_date(text: str, move: Callable) -> str | None:
    """A day, an English month's name and a year, in either order. Long and short names, and days of one and of two digits, stay of their kind."""
    year, name, day = text[-4:], re.search(_MONTH, text).group(), re.search("[0-9]{1,2}", text[:-4]).group()
    month = next(i for i, m in enumerate(MONTHS) if m[:3] == name[:3])
    short = name != MONTHS[month]
    fits = lambda d: (int(d[2]) < 10) == (int(day) < 10) and not (short and d[1] == "05")  # noqa: E731  May has no short name
    new = _date(year, f"{month + 1:02d}", f"{int(day):02d}", move)
    while new and not fits(new):
        new = _date(*new, move)
    if not new:
        return None
    fresh = MONTHS[int(new[1]) - 1]
    fresh = fresh[:3] if short else fresh
    number = new[2] if len(day) == 2 else str(int(new[2]))
    return text[:-4].replace(day, number, 1).replace(name, fresh, 1) + new[0]


def _email(text: str, move: Callable) -> str:
    """The local part, letter for letter and digit for digit; the domain stays, as it names no person."""
    return _by_place(text, _classes(text, 0, text.index("@")), move)


#: kind, pattern, pseudonym. Earlier kinds win where matches overlap. The bounds keep parts of longer numbers out. A digit after a kind's name
#: sets several forms of one kind apart.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.%+-])(?u:\w)(?u:[\w.%+-]){0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", _IBAN, _iban),
    ("iban2", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _other_iban),
    ("card", r"(?<![0-9.-])[0-9](?:[0-9]{12,18}|[0-9]{3}(?:(?:[\x20-][0-9]{4}){3}|[\x20-][0-9]{6}[\x20-][0-9]{4,5}))(?![0-9]|[.-][0-9])", _card),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _ip),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])", _ip6),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("date", r"(?<![0-9/.-])[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}(?![0-9]|[-/][0-9])", _iso_date),
    ("date2", r"(?<![0-9/.-])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}(?![0-9]|[-/.][0-9])", _day_first),
    ("date3", rf"(?<![0-9A-Za-z.-])(?:[0-9]{{1,2}}\x20(?:{_MONTH}),?|(?:{_MONTH})\x20[0-9]{{1,2}},?)\x20[0-9]{{4}}(?![0-9A-Za-z])", _written_date),
    ("phone", r"(?<![0-9A-Za-z.-])(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])", _phone),
    ("phone2", r"(?<![0-9A-Za-z.+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z]|[.-][0-9])", _phone),
    ("phone3", r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,6}(?![0-9A-Za-z]|[.-][0-9])", _world_phone),
)
REPORTED = ("email", "iban", "card", "ip", "ssn", "date", "phone")
#: A text without this has no match of any kind (RE2).
SIEVE = r"[0-9][0-9]|[0-9]\.[0-9]|@|:[0-9A-Fa-f]{0,4}:"


class Pseudonymizer:
    def __init__(self, key: str, back: bool = False):
        if not key:
            raise ValueError("a secret key is needed: whoever knows it can reverse the pseudonyms")
        self.key, self.back = hashlib.blake2b(key.encode(), digest_size=32).digest(), back
        self.patterns = [(k.rstrip("236"), re.compile(p, re.ASCII), f) for k, p, f in KINDS]
        self.value = lru_cache(maxsize=1 << 16)(self._value)

    def _value(self, kind: str, text: str, make: Callable) -> str | None:
        return make(text, lambda n, x: _feistel(self.key, kind, n, x, self.back))

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of what is valid, in order, without overlaps. Each kind's matches are merged into those of the earlier kinds."""
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern, make in self.patterns:
            fresh, free = [], 0
            starts = [t[0] for t in taken]
            for m in pattern.finditer(text):
                s, e = m.span(1 if pattern is _OWN_LENGTH else 0)
                at = bisect_right(starts, s)
                if s < free or at and taken[at - 1][1] > s or at < len(taken) and starts[at] < e:
                    continue
                if (new := self.value(kind, text[s:e], make)) is not None:
                    fresh.append((s, e, kind, new))
                    free = e
            if fresh:
                taken = list(heapq.merge(taken, fresh)) if taken else fresh
        return taken

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans, parts, at = self.spans(text), [], 0
        for s, e, _, new in spans:
            parts += [text[at:s], new]
            at = e
        return "".join(parts) + text[at:], spans


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """One row per document: id, text with pseudonyms, a count per kind, and ``pii_spans`` (kind:start:end in the input, code points).

    A null text stays null with zero counts, an empty one empty. Invalid values (failed check digit, impossible date or octet) stay as they are.
    Where kinds overlap, the one that KINDS names first wins. Texts of any length are read whole, in time linear but for the sorting of spans.
    Repeated rows give repeated results, an empty table none. ``back=True`` with the same key restores the originals; ``key`` is the caller's
    secret and has no default. Other input columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonymizer(key, back)
        for batch in batches:
            texts = batch.column(1)
            rows = np.flatnonzero(pc.match_substring_regex(filled(texts), SIEVE).to_numpy(zero_copy_only=False))
            counts, spans, fresh = np.zeros((len(REPORTED), len(texts)), np.int64), [""] * len(texts), {}
            for i in map(int, rows):
                text, found = tool.rewrite(texts[i].as_py())
                if found:
                    fresh[i] = text
                    spans[i] = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)
                    for _, _, k, _ in found:
                        counts[REPORTED.index(k), i] += 1
            if fresh:
                changed = np.zeros(len(texts), bool)
                changed[list(fresh)] = True
                texts = pc.replace_with_mask(texts, pa.array(changed), pa.array([fresh[i] for i in sorted(fresh)], texts.type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, *(pa.array(c) for c in counts), pa.array(spans, pa.string())],
                [id_col, text_col, *(f"n_{k}" for k in REPORTED), "pii_spans"],
            )

    schema = schema_of(docs, [id_col, text_col], ", ".join(f"n_{k} long" for k in REPORTED) + ", pii_spans string")
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, schema)
