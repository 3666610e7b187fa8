"""Which titles of two sets can score a given similarity at most: a sieve of two bounds, whole sets at a time.

The first bound is made for all pairs from products of small matrices of character pairs, triples and words (ideographs, where both titles
have some). The ratio's part of it follows from the shared pairs: blocks of matching letters are apart by a letter that does not match. What it leaves, about
one pair of prose in a hundred, is held against the longest common subsequence, 64 places at a time; no ratio is larger than that allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..functions import kernels

#: Columns of the matrices of character pairs, triples and words: of the more frequent half of them each has an entry of its own.
WIDTHS = (384, 512, 128)
#: Rows and columns of a product; pairs whose subsequences are sought at once.
ROWS, COLUMNS, AT_ONCE = 512, 512, 1 << 14
#: Letters told apart in subsequences; one more stands for the end.
LETTERS = 255
#: Weights of ratio, character pairs, triples, and words or ideographs in the title score (fixed values; see kernels.title, kernels.combined).
PROSE, DRAWN = (0.30, 0.25, 0.30, 0.15), (0.25, 0.30, 0.25, 0.20)


def formed(titles: pd.Series) -> pd.DataFrame:
    """(clean, words, form) of titles: what the sieve looks at. Costlier than a title's share of a block, so made once."""
    clean = titles.map(kernels.clean)
    return pd.DataFrame({"clean": clean, "words": clean.map(kernels.general), "form": titles.map(kernels.title_form)})


def _grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all runs of k characters; a shorter text is one run."""
    size = np.array([len(t) for t in texts], dtype="int64")
    chars = np.frombuffer("".join(t + "\0" * k for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    count = np.maximum(size - k, 0) + 1
    start = np.cumsum(size + k) - (size + k)
    at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
    code = chars[at]
    for i in range(1, k):
        code = code | chars[at + i] << np.uint64(21 * i)
    return np.repeat(np.arange(len(texts)), count), code


def _units(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), pd.factorize(np.array([x for s in sets for x in s], dtype=object))[0]


def _numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each code, how often each number occurs): 0 is the most frequent."""
    kind = pd.factorize(code)[0]
    count = np.bincount(kind)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(count), dtype="int64")
    rank[order] = np.arange(len(count))
    return rank[kind], count[order]


def _held(row: np.ndarray, code: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, number of different codes of each row). Columns may stand for several codes: that can only add to what is shared."""
    if not len(code):
        return np.zeros((n, 1), dtype="float32"), np.zeros(n, dtype="float32")
    kind, count = _numbered(code)
    own = pd.unique(row * len(count) + kind)
    row, kind = own // len(count), own % len(count)
    half = width // 2
    column = np.where(kind < half, kind, half + (kind - half) % half)
    held = np.zeros(n * width, dtype="float32")
    np.add.at(held, row * width + column, np.float32(1))
    return held.reshape(n, width)[:, : len(count)], np.bincount(row, minlength=n).astype("float32")


class _Side:
    """Titles in the form that bounds are made of; ``part`` picks some."""

    def __init__(self, clean: list[str], held: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray, spare: np.ndarray):
        self.clean, self.held, self.letters, self.spare = clean, held, letters, spare
        self.spaces = np.array([t.count(" ") for t in clean], dtype="float32")

    def part(self, at: slice) -> _Side:
        return _Side(self.clean[at], [(m[at], s[at]) for m, s in self.held], self.letters[at], self.spare[at])


def _sides(first: pd.DataFrame, second: pd.DataFrame, drawn: bool) -> tuple[_Side, _Side]:
    both = pd.concat([first, second], ignore_index=True)
    clean = both["clean"].tolist()
    bare = [t.replace(" ", "") for t in clean]
    units = [set(kernels.ideographs(t)) for t in clean] if drawn else [set(w.split()) for w in both["words"]]
    pairs, triples = _grams(bare, 2), _grams(bare, 3)
    held = [_held(*codes, len(both), width) for codes, width in zip((pairs, triples, _units(units)), WIDTHS, strict=True)]
    spare = np.bincount(pairs[0], minlength=len(both)) - held[0][1]  # places of a title that repeat a pair
    side = _Side(clean, held, np.array([len(t) for t in bare], dtype="float32"), spare.astype("float32"))
    return side.part(slice(0, len(first))), side.part(slice(len(first), None))


def _bounded(a: _Side, b: _Side, least: float, drawn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, rest) of the pairs that can score ``least`` by the first bound; rest is what they score at most without the ratio."""
    share, *weights = DRAWN if drawn else PROSE
    rest, shared = None, []
    for (x, n), (y, m), weight in zip(a.held, b.held, weights, strict=True):
        met = x @ y.T
        other = np.maximum(np.add.outer(n, m) - met, 1)
        part = np.divide(met, other, out=other)
        part *= weight
        if not (n.all() and m.all()):
            part[np.ix_(n == 0, m == 0)] = weight  # nothing on either side is all the same
        rest = part if rest is None else np.add(rest, part, out=rest)
        shared.append(met)
    # M letters in K blocks: M - K places share a pair, K - 1 letters do not match
    most = shared[0]
    most += np.add.outer(a.letters + 1 + a.spare, b.letters)
    most /= 3
    np.minimum(most, np.minimum.outer(a.letters, b.letters), out=most)
    if drawn:  # ideographs that both have, and all other places of the shorter rest
        np.minimum(most, shared[2] + np.minimum.outer(a.letters - a.held[2][1], b.letters - b.held[2][1]), out=most)
    most += np.minimum.outer(a.spaces, b.spaces)
    most *= 2 * share
    most /= np.maximum(np.add.outer(a.letters + a.spaces, b.letters + b.spaces), 1)
    most += rest
    i, j = np.nonzero(most >= least)
    return i, j, rest[i, j]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, letter) of all characters, letters numbered by frequency; rare ones may share a number."""
    size = np.array([len(t) for t in texts], dtype="int64")
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.repeat(np.arange(len(texts)), size), np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size), _numbered(chars)[0] % LETTERS


def common(first: list[str], second: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The longest common subsequences of first[i] and second[j], or more: of longer texts, the sum over their parts of 64 places."""
    row, place, letter = _coded(first + second)
    mine = row < len(first)
    other = np.full((len(second), max(map(len, second), default=0)), LETTERS, dtype="int64")
    other[row[~mine] - len(first), place[~mine]] = letter[~mine]
    found = np.zeros(len(i), dtype="int64")
    for part in range(0, max(map(len, first), default=0), 64):
        at = mine & (place >= part) & (place < part + 64)
        where = np.zeros((len(first), LETTERS + 1), dtype="uint64")
        np.bitwise_or.at(where, (row[at], letter[at]), np.uint64(1) << (place[at] - part).astype("uint64"))
        flat = where.ravel()
        for low in range(0, len(i), AT_ONCE):
            base, theirs = i[low : low + AT_ONCE] * (LETTERS + 1), other[j[low : low + AT_ONCE]].T.copy()
            free = np.full(len(base), ~np.uint64(0))
            for letters in theirs:
                hit = free & flat[base + letters]
                free = (free + hit) | (free - hit)
            found[low : low + AT_ONCE] += np.bitwise_count(~free)
    return found


def _sieved(first: pd.DataFrame, second: pd.DataFrame, least: float, drawn: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(first) or not len(second):
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    a, b = _sides(first, second, drawn)
    columns = [(low, b.part(slice(low, low + COLUMNS))) for low in range(0, len(second), COLUMNS)]
    found = [(i + up, j + low, rest) for up in range(0, len(first), ROWS) for part in [a.part(slice(up, up + ROWS))] for low, own in columns for i, j, rest in [_bounded(part, own, least, drawn)]]
    i, j, rest = (np.concatenate(x) for x in zip(*found, strict=True))
    size = [np.array([len(t) for t in s.clean]) for s in (a, b)]
    ratio = 2 * common(a.clean, b.clean, i, j) / np.maximum(size[0][i] + size[1][j], 1)
    share, *weights = DRAWN if drawn else PROSE
    kept = rest + share * ratio >= least
    i, j, ratio = i[kept], j[kept], ratio[kept]
    names = (first["clean"] if drawn else first["words"]).tolist(), (second["clean"] if drawn else second["words"]).tolist()
    split = (lambda t: set(kernels.ideographs(t))) if drawn else (lambda t: set(t.split()))
    exact = [(kernels.ngram(a.clean[x], b.clean[y], 2), kernels.ngram(a.clean[x], b.clean[y], 3), kernels.jaccard(split(names[0][x]), split(names[1][y]))) for x, y in zip(i, j, strict=True)]
    kept = share * ratio + np.array(exact, dtype="float64").reshape(-1, 3) @ weights >= least
    return i[kept], j[kept]


def close(first: pd.DataFrame, second: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the titles of ``first`` and ``second``, both formed(), among which are all that score ``least`` in either order."""
    least -= 1e-4  # sums are made in 32 bits
    drawn = [x["clean"].map(lambda t: bool(kernels.ideographs(t))).to_numpy(dtype=bool) for x in (first, second)]
    found = []
    for mine, theirs, both in ((drawn[0], drawn[1], True), (drawn[0], ~drawn[1], False), (~drawn[0], drawn[1] | ~drawn[1], False)):
        at = np.nonzero(mine)[0], np.nonzero(theirs)[0]
        i, j = _sieved(first.iloc[at[0]], second.iloc[at[1]], least, both)
        found.append((at[0][i], at[1][j]))
    for name, some in (("clean", False), ("words", True), ("form", True)):  # equal names decide alone
        sides = [pd.DataFrame({"name": x[name].to_numpy(), s: np.arange(len(x))}) for x, s in ((first, "i"), (second, "j"))]
        same = sides[0].merge(sides[1], on="name")
        same = same[same["name"] != ""] if some else same
        found.append((same["i"].to_numpy(dtype="int64"), same["j"].to_numpy(dtype="int64")))
    pairs = np.unique(np.concatenate([i * np.int64(len(second)) + j for i, j in found]))
    return pairs // max(len(second), 1), pairs % max(len(second), 1)
