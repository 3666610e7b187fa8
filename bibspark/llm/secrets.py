"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must
contain. Every block of texts gets an inverted index of just those trigrams (trigram -> sorted list
of texts); postings are intersected and united as the query says, and only the candidates are
verified with the regular expression on their whole text. Rules without a mandatory trigram (long
hex runs) scan every whole text with a linear-time automaton first.

Everything is narrow: no shuffle, no driver state, memory bounded by one block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bounded_batches, bytes_of, column, filled, schema_of, text_slices

_parser = re._parser  # the standard library's own regular expression parser


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, non-overlapping; a match is dropped if ``group`` has under ``least`` characters.

    ``scan`` is an equivalent yes/no pattern in RE2 syntax, for rules that no trigram can answer.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    scan: str | None = None

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base rules, in the order that breaks ties.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, scan="[0-9a-f]{32}"),
)
#: Further kinds; they add spans and never remove one of the above.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    # it begins where its run of characters begins, else every start in a long run without a dot would read the run to its end
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
DEFAULT_RULES = BASE_RULES + MORE_RULES

# ---------------------------------------------------------------- trigram queries
# A query is True (no condition), ("tri", t), ("and", [...]) or ("or", [...]).
MOST_STRINGS = 96


def _all_of(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any_of(parts: list) -> object:
    if any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[bytes]) -> object:
    """Condition that a text has one of the strings."""
    return _any_of([_all_of([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _chars(items: list) -> set[bytes] | None:
    out: set[int] = set()
    for op, value in items:
        if op is _parser.LITERAL:
            out.add(value)
        elif op is _parser.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            return None
        if len(out) > MOST_STRINGS:
            return None
    return {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in out}


def _walk(tree: object) -> tuple[set[bytes] | None, object]:
    """(all strings that the tree can match, or None if they are too many; a necessary condition). ASCII case is folded."""
    current: set[bytes] = {b""}
    parts: list = []
    exact = True

    def flush() -> None:
        nonlocal current
        parts.append(_of_strings(current))
        current = {b""}

    for op, value in tree:
        strings: set[bytes] | None = None
        condition: object = True
        if op is _parser.LITERAL:
            strings = _chars([(op, value)])
        elif op is _parser.IN:
            strings = _chars(value)
        elif op is _parser.AT:
            strings = {b""}
        elif op is _parser.SUBPATTERN:
            strings, condition = _walk(value[3])
        elif op is _parser.BRANCH:
            ways = [_walk(x) for x in value[1]]
            condition = _any_of([q if s is None else _of_strings(s) for s, q in ways])
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            least, most, inner = value
            one, needed = _walk(inner)
            if least == 0 and most == 1 and one is not None:
                strings = one | {b""}
            elif least >= 1:
                condition = needed if one is None else _of_strings(one)
        if strings is not None and len(strings) * len(current) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}
        else:
            exact = False
            flush()
            parts.append(condition if strings is None else _of_strings(strings))
    if exact:
        return current, _of_strings(current)
    flush()
    return None, _all_of(parts)


def trigram_query(pattern: str) -> object:
    """Boolean trigram query that every text with a match fulfils; True if there is no mandatory trigram."""
    strings, condition = _walk(_parser.parse(pattern, re.ASCII))
    return condition if strings is None else _of_strings(strings)


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(q) for q in query[1]))


def candidates(query: object, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Sorted text numbers that fulfil a query other than True."""
    if query[0] == "tri":
        return postings.get(query[1], np.zeros(0, np.int64))
    lists = [candidates(q, postings) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    lists.sort(key=len)
    found = lists[0]
    for other in lists[1:]:
        if not len(found):
            break
        found = np.intersect1d(found, other, assume_unique=True)
    return found


# ---------------------------------------------------------------- index and scan
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TrigramIndex:
    """Inverted index of chosen trigrams for one block of texts after another."""

    STEP = 1 << 20

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.names = sorted(set().union(*(trigrams_of(q) for q in self.queries)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.names):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        self.patterns = [r.compiled() for r in rules]

    def postings(self, data: np.ndarray, at: np.ndarray) -> dict[bytes, np.ndarray]:
        """trigram -> sorted numbers of the texts that hold it (a trigram across two texts counts for the first; verification decides)."""
        pairs = []
        for start in range(0, max(len(data) - 2, 0), self.STEP):
            low = _LOWER[data[start : start + self.STEP + 2]].astype(np.uint32)
            codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            number = self.number[codes]
            where = np.flatnonzero(number)
            text = np.searchsorted(at, where + start, "right") - 1
            pairs.append(np.unique(number[where].astype(np.int64) << 40 | text))
        if not pairs:
            return {}
        both = np.unique(np.concatenate(pairs))
        cut = np.searchsorted(both >> 40, np.arange(1, len(self.names) + 2))
        text = both & ((1 << 40) - 1)
        return {t: text[cut[i] : cut[i + 1]] for i, t in enumerate(self.names)}

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), in code points."""
        data, at = bytes_of(texts)
        postings = self.postings(data, at)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns, strict=True)):
            if query is not True:
                rows = candidates(query, postings)
            elif rule.scan:
                rows = np.flatnonzero(pc.match_substring_regex(texts, rule.scan).to_numpy(zero_copy_only=False))
            else:
                rows = np.arange(len(texts))
            for i in rows:
                text = texts[int(i)].as_py()
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in found:
            spans.sort()
        return found


BLOCK_BYTES = 4 << 20


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES, n_base: int = len(BASE_RULES)) -> DataFrame:
    """One row per document: counts of the first ``n_base`` kinds, their digest, and all spans ``kind:start:end`` (code points, end exclusive).

    Null or empty text: zero counts, empty ``spans``. Spans that start together stand in the order of their kinds. Texts of any length are read
    whole, in linear time. Repeated rows give repeated results, an empty table none; other input columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kinds = [r.kind for r in rules]
    base = kinds[:n_base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        for batch in batches:
            texts = filled(batch.column(1))
            counts: list[list[int]] = [[] for _ in base]
            digests, spans = [], []
            for a, b in text_slices(texts, BLOCK_BYTES):
                for found in index.scan(texts.slice(a, b - a)):
                    own = [x for x in found if x[1] < n_base]
                    for k in range(n_base):
                        counts[k].append(sum(x[1] == k for x in own))
                    digests.append(hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest())
                    spans.append(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                [id_col, *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    schema = schema_of(docs, [id_col], ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string")
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, schema)
