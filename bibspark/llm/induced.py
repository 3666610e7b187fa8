"""Suffix order and common prefixes of a text by external induced sorting.

A suffix is of kind S if it comes before the suffix one place on, else of kind L; an S suffix after an
L one is S*. Suffix tuples (symbol, place, common prefix with the tuple before it under that symbol)
go through disk-backed priority queues, least symbol first, equal symbols in order of arrival. The
pass up takes tuples in order, S* suffixes among them where their symbols' turn comes, and pushes the
suffix one place before each if it is L; the pass down does the same from the end for S. Common
prefixes are induced along with the order: of two suffixes pushed one after the other under a symbol it
is one more than the least common prefix between those that pushed them.

The S* suffixes are first put in order of their substrings, from one S* place to the next, by the same
two passes; equal substrings get equal names, and the string of names is sorted by recursion unless
all names differ. Queues become runs on disk as soon as they hold more than a given number of tuples;
texts, kinds and orders are kept in files that are mapped into memory, so that a text can be far
larger than memory. All files lie in one scratch folder of the running task and go with it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples that a queue holds in memory; the same for any text.
QUEUED = 1 << 18
#: Bytes that count as one tuple where arrays are held.
TUPLE_BYTES = 32
#: Tuples that a queue sorts at once in memory.
PART = 1 << 14
#: Tuples of one piece of a result; tuples that a pass over names takes at once. With up to FEW symbols these come one by one.
PIECE, STEP, FEW = 1 << 18, 1 << 13, 1 << 10
#: Rounds in which tuples taken at once may still move.
MOST_ROUNDS = 10
_NONE, _NO_PREFIX = np.zeros(0, np.int64), np.zeros(0, np.int32)


class Scratch:
    """Files of one sort. Arrays of over ``most`` tuples' size go to disk and come back mapped into memory; a file has no name any more once it is
    mapped, so that its space is free as soon as its array is."""

    def __init__(self, most: int):
        self.most_bytes, self.folder, self.count = most * TUPLE_BYTES, None, 0

    def path(self) -> str:
        self.folder = self.folder or tempfile.mkdtemp(prefix="induce-")
        self.count += 1
        return f"{self.folder}/{self.count}"

    def mapped(self, path: str, dtype: np.dtype) -> np.ndarray:
        values = np.asarray(np.memmap(path, dtype, "r"))
        os.unlink(path)
        return values

    def put(self, values: np.ndarray) -> np.ndarray:
        values.tofile(path := self.path())
        return self.mapped(path, values.dtype)

    def hold(self, values: np.ndarray) -> np.ndarray:
        return values if values.nbytes <= self.most_bytes else self.put(values)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Sequence:
    """Arrays appended piece by piece, read as one; on disk once they outgrow the scratch folder's limit."""

    def __init__(self, scratch: Scratch, dtype: type):
        self.scratch, self.parts, self.path, self.held, self.dtype = scratch, [], None, 0, np.dtype(dtype)

    def add(self, values: np.ndarray) -> None:
        self.parts.append(values.astype(self.dtype, copy=False))
        self.held += self.parts[-1].nbytes
        if self.held > self.scratch.most_bytes:
            self._write()

    def _write(self) -> None:
        self.path = self.path or self.scratch.path()
        with open(self.path, "ab") as file:
            for part in self.parts:
                part.tofile(file)
        self.parts, self.held = [], 0

    def whole(self) -> np.ndarray:
        if self.path is None:
            return np.concatenate([np.zeros(0, self.dtype), *self.parts])
        self._write()
        return self.scratch.mapped(self.path, self.dtype)


class SuffixQueue:
    """Monotone priority queue of suffix tuples: what is pushed never comes before what has been taken. Full buffers become sorted parts, and these, when they
    hold more than ``most`` tuples together, one run on disk, sorted by symbol."""

    def __init__(self, scratch: Scratch, most: int, place: type):
        self.scratch, self.most, self.buffer, self.size, self.parts, self.held, self.runs = scratch, most, [], 0, [], 0, []
        self.kinds = (np.int32, place, np.int32) if place is np.int32 else (np.int64, place, np.int32)  # names are no more than places

    def push(self, *columns: np.ndarray) -> None:
        """Symbols, places, common prefixes; in order of arrival."""
        self.buffer.append(columns)
        self.size += len(columns[0])
        if self.size > min(PART, self.most):
            self.parts.append([0, *self._by_symbol(self.buffer)])
            self.held, self.buffer, self.size = self.held + self.size, [], 0
            if self.held > self.most:
                columns = self._by_symbol([[x[part[0] :] for x in part[1:]] for part in self.parts])
                self.runs.append([0, *(self.scratch.put(x.astype(kind, copy=False)) for x, kind in zip(columns, self.kinds, strict=True))])
                self.parts, self.held = [], 0

    @staticmethod
    def _by_symbol(pieces: list) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*pieces, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return [x[order] for x in columns]

    def take(self, end: int) -> tuple[np.ndarray, ...]:
        """All tuples with a symbol under ``end``, by arrival as far as they share a symbol."""
        found = []
        for run in self.runs:
            start, run[0] = run[0], max(int(np.searchsorted(run[1], end)), run[0])
            found.append([run[1][start : run[0]].astype(np.int64), run[2][start : run[0]].astype(np.int64), np.array(run[3][start : run[0]])])
        for part in self.parts:
            start, part[0] = part[0], max(int(np.searchsorted(part[1], end)), part[0])
            self.held -= part[0] - start
            found.append([x[start : part[0]] for x in part[1:]])
        self.runs, self.parts = ([x for x in kept if x[0] < len(x[1])] for kept in (self.runs, self.parts))
        if self.buffer:
            columns = [np.concatenate(x) for x in zip(*self.buffer, strict=True)]
            due = columns[0] < end
            found.append([x[due] for x in columns])
            self.buffer, self.size = [[x[~due] for x in columns]], int(len(due) - due.sum())
        if not found:
            return _NONE, _NONE, _NO_PREFIX
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _place_type(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values`` from each first to each last place, by minima over powers of two."""
    out = np.empty(len(first), values.dtype)
    level = np.log2(last - first + 1).astype(np.int64) if len(first) else _NONE
    row = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        mine = level == k
        out[mine] = np.minimum(row[first[mine]], row[last[mine] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :]) if len(row) > 1 << k else row
    return out


class _Seeds:
    """Suffixes in order that a pass meets by the way: symbol, place, common prefix with the one before. Read in slices."""

    def __init__(self, size: int, read: Callable[[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]], upto: np.ndarray):
        self.size, self.read, self.upto, self.at = size, read, upto, 0  # upto: how many have a symbol of at most each one

    def take(self, end: int) -> tuple[np.ndarray, ...]:
        start, self.at = self.at, max(int(self.upto[end - 1]), self.at)
        return self.read(start, self.at)

    def back(self, end: int) -> None:
        """As if only those with a symbol under ``end`` had been taken."""
        self.at = int(self.upto[end - 1]) if end else 0


def _by_key(key: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; numbers of two bytes are dealt out instead of compared."""
    return np.argsort(key.astype(np.uint16) if not len(key) or key.max() < 1 << 16 else key, kind="stable")


class _Pass:
    """One pass over the suffixes in order. In the pass down symbols are counted from ``mirror`` down.

    ``room``: suffixes under each symbol. ``step``: tuples taken from the queue at once, but whole symbols. ``length``: common prefixes are
    kept up to it; 0: not at all. ``out`` gets the places (and common prefixes) of the pushed kind in order.
    """

    def __init__(self, text: np.ndarray, kind: np.ndarray, want: bool, mirror: int, room: np.ndarray, step: int, length: int, most: int, scratch: Scratch, out: tuple[Sequence, Sequence]):
        self.text, self.kind, self.want, self.mirror, self.length, self.out = text, kind, want, mirror, length, out
        self.ends, self.step, self.queue = np.cumsum(room), step, SuffixQueue(scratch, most, _place_type(len(text)))
        self.gap = np.full(len(room) if length else 0, -1, np.int32)  # least common prefix since the last push under each symbol; none yet
        self.before: tuple[int, int, int] = (-1, -1, 0)  # symbol, place and turn of the last suffix met

    def symbol_of(self, place: np.ndarray) -> np.ndarray:
        own = self.text[place].astype(np.int64)
        return own if self.mirror < 0 else self.mirror - own

    def pushes(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the places push the one before, under which symbols)."""
        prior = np.maximum(place, 1) - 1
        at = np.flatnonzero((place > 0) & (self.kind[prior] == self.want))
        return at, self.symbol_of(prior[at])

    def run(self, start: np.ndarray, seeds: _Seeds) -> None:
        if len(start):
            self.queue.push(self.symbol_of(start), start, np.zeros(len(start), np.int32))
            if self.length:
                self.gap[self.symbol_of(start)] = self.length
        lo, sigma, alone = 0, len(self.ends), False
        waiting: tuple[np.ndarray, ...] = (_NONE, _NONE, _NO_PREFIX)  # taken, but not due yet
        while lo < sigma:
            held = int(self.ends[lo - 1]) if lo else 0
            hi = lo + 1 if alone else min(max(int(np.searchsorted(self.ends, held + self.step, "right")), lo + 1), lo + (1 << 14))
            due = waiting[0] < hi
            s, p, v = (np.concatenate([x[due], y]) for x, y in zip(waiting, self.queue.take(hi), strict=True))
            waiting = tuple(x[~due] for x in waiting)
            t, q, w = seeds.take(hi)
            if hi == lo + 1:
                self.one_symbol(lo, p, v, q, w)
                lo, alone = hi, False
                continue
            upto = self.some_symbols(lo, hi, np.concatenate([2 * (s - lo), 2 * (t - lo) + 1]), np.concatenate([p, q]))
            if upto < hi:
                left = s >= upto
                waiting = tuple(np.concatenate([x[left], y]) for x, y in zip((s, p, v), waiting, strict=True))
                seeds.back(upto)
            lo, alone = upto, upto < hi

    def some_symbols(self, lo: int, hi: int, base_key: np.ndarray, base: np.ndarray) -> int:
        """Suffixes of several symbols at once, without common prefixes: what they push among themselves is put in its place until nothing moves.

        Gives the symbol up to which they are done: a long run of one symbol takes a round for each repeat, and is left to one_symbol().
        """
        key, place = base_key, base
        order = _by_key(key)
        key, place, upto = key[order], place[order], hi
        for _ in range(MOST_ROUNDS):
            at, to = self.pushes(place)
            due = to < hi
            fresh_key, fresh = np.concatenate([base_key, 2 * (to[due] - lo)]), np.concatenate([base, place[at[due]] - 1])
            order = _by_key(fresh_key)
            fresh_key, fresh = fresh_key[order], fresh[order]
            shared = min(len(fresh), len(place))
            other = np.flatnonzero(fresh[:shared] != place[:shared])
            if len(fresh) == len(place) and not len(other):
                break
            upto = lo + int(fresh_key[other[0] if len(other) else shared] >> 1)
            key, place = fresh_key, fresh
        else:
            place, key = place[: (stop := int(np.searchsorted(key, 2 * (upto - lo))))], key[:stop]
            at, to = self.pushes(place)
            due = to < upto
            hi = upto
        self.out[0].add(place[key & 1 == 0])
        if not due.all():
            self.queue.push(to[~due], place[at[~due]] - 1, np.zeros(int(len(due) - due.sum()), np.int32))
        return hi

    def one_symbol(self, symbol: int, place: np.ndarray, common: np.ndarray, seed: np.ndarray, seed_common: np.ndarray) -> None:
        """Suffixes of one symbol: those pushed, round by round what these push under the same symbol, then the seeds."""
        turn = 0
        while True:
            if len(place):
                if not turn:
                    self.out[0].add(place)
                at, to = self.pushes(place)
                carried = self.carry(symbol, turn, place, common, at, to) if self.length else np.zeros(len(at), np.int32)
                again = (to == symbol) if not turn else np.zeros(len(to), bool)
                if not again.all():
                    self.queue.push(to[~again], place[at[~again]] - 1, carried[~again])
                place, common = place[at[again]] - 1, carried[again]
            if not len(place):
                if turn:
                    return
                place, common, turn = seed, seed_common, 1

    def carry(self, symbol: int, turn: int, place: np.ndarray, common: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Common prefixes of what is pushed."""
        common = common.copy()
        if self.before[0] != symbol:
            common[0] = 0
        elif turn and not self.before[2]:  # from one kind to the other: as far as both repeat the symbol
            common[0] = min(_run_length(self.text, self.before[1], self.length), _run_length(self.text, int(place[0]), self.length))
        self.before = (symbol, int(place[-1]), turn)
        if not turn:
            self.out[1].add(common)
        order = _by_key(to)
        where, under = at[order], to[order]
        head = np.append(True, under[1:] != under[:-1]) if len(under) else np.zeros(0, bool)
        first = np.where(head, 0, np.append(0, where[:-1] + 1)) if len(where) else _NONE
        least = _least(common, first, where)
        least[head] = np.minimum(least[head], self.gap[under[head]])
        carried = np.empty(len(at), np.int32)
        carried[order] = np.minimum(least + 1, self.length)
        rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.int32(self.length))  # least from each place on
        self.gap = np.minimum(self.gap, rest[0])
        tail = np.append(head[1:], True) if len(head) else head
        self.gap[under[tail]] = rest[where[tail] + 1]
        return carried


def _kinds(text: np.ndarray) -> np.ndarray:
    """Which places are of kind S, block by block from the end; the last one is L."""
    n, kind, later, after = len(text), np.zeros(len(text), bool), False, -1
    for stop in range(n, 0, -PIECE):
        start = max(stop - PIECE, 0)
        own = np.append(text[start:stop].astype(np.int64), after)
        rises, same = own[:-1] < own[1:], own[:-1] == own[1:]
        # equal symbols take the kind of the next place that differs
        spot = np.where(same, len(own), np.arange(len(own) - 1))
        spot = np.minimum.accumulate(spot[::-1])[::-1]
        kind[start:stop] = np.where(spot < len(own), rises[np.minimum(spot, len(own) - 2)], later)
        later, after = bool(kind[start]), int(own[0])
    return kind


def _run_length(text: np.ndarray, at: int, most: int) -> int:
    own = text[at : at + most]
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` symbols from each a and each b on are equal."""
    equal, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        good = text[a[live] + k] == text[b[live] + k]
        equal[live[~good]] = False
        k += 1
        live = live[good]
        live = live[size[live] > k]
    return equal


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at each a and b, up to ``most``; bytes are compared eight at a time while there are eight."""
    out, live, n = np.zeros(len(a), np.int32), np.arange(len(a)), len(text)
    if text.dtype == np.uint8 and n >= 8:
        eight = np.ndarray(n - 7, np.uint64, np.ascontiguousarray(text), 0, (1,))
        going = live
        for k in range(0, most - 7, 8):
            x, y = a[going] + k, b[going] + k
            good = (x < n - 7) & (y < n - 7)
            good[good] = eight[x[good]] == eight[y[good]]
            going = going[good]
            out[going] = k + 8
            if not len(going):
                break
    for _ in range(most):
        x, y = a[live] + out[live], b[live] + out[live]
        good = (x < n) & (y < n) & (out[live] < most)
        live, x, y = live[good], x[good], y[good]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def suffix_order(text: np.ndarray, length: int = 0, most: int = QUEUED, scratch: Scratch | None = None, step: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes with the suffix before, up to ``length``) of all suffixes in order, piece by piece. A suffix that begins another comes first.

    ``text`` holds numbers from 0 on, bytes or names without gaps.
    """
    if not len(text):
        return
    own = scratch or Scratch(most)
    try:
        yield from _sorted(own.hold(text), length, most, own, step)
    finally:
        if scratch is None:
            own.close()


def _sorted(text: np.ndarray, length: int, most: int, scratch: Scratch, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(text)
    kind = scratch.hold(_kinds(text))
    sigma = int(text.max()) + 1
    room = np.bincount(text, minlength=sigma)
    step = step or (STEP if sigma > FEW else 0)
    star = scratch.hold((np.flatnonzero(kind[1:] & ~kind[:-1]) + 1).astype(_place_type(n)))

    def both(seeds: np.ndarray, prefixes: np.ndarray | None, keep: int) -> tuple[np.ndarray, ...]:
        """L suffixes in order and S suffixes in reverse order, each with common prefixes, induced from S* suffixes in order."""
        large, small = ((Sequence(scratch, _place_type(n)), Sequence(scratch, np.int32)) for _ in range(2))
        blank = lambda a, b: np.zeros(b - a, np.int32)
        read = lambda a, b: (text[seeds[a:b]].astype(np.int64), seeds[a:b].astype(np.int64), blank(a, b) if prefixes is None else prefixes[a:b])
        upto = np.cumsum(np.bincount(text[seeds], minlength=sigma)) if len(seeds) else np.zeros(sigma, np.int64)
        own = 0 if keep else step  # common prefixes: one symbol at a time
        _Pass(text, kind, False, -1, room, own, keep, most, scratch, large).run(np.array([n - 1]), _Seeds(len(seeds), read, upto))
        places, commons = large[0].whole(), large[1].whole()
        size = len(places)

        def back(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = places[size - b : size - a][::-1].astype(np.int64)
            # with the next larger one, which comes before it here
            after = np.append(commons[size - b + 1 : size - a + 1], np.zeros(1, np.int32))[: b - a][::-1] if keep else blank(a, b)
            return sigma - 1 - text[own].astype(np.int64), own, after

        counts = np.bincount(text[places], minlength=sigma)[::-1]
        _Pass(text, kind, True, sigma - 1, room[::-1], own, keep, most, scratch, small).run(_NONE, _Seeds(size, back, np.cumsum(counts)))
        return places, commons, small[0].whole(), small[1].whole()

    if len(star) > 1:
        rough = star[np.argsort(text[star], kind="stable")]
        down = both(rough, None, 0)[2]
        order = down[(down > 0) & ~kind[np.maximum(down, 1) - 1]][::-1].astype(np.int64)
        del down
        # names: equal substrings, from one S* place to the next, share one
        turn = np.empty(n, star.dtype)
        turn[star] = np.arange(len(star))
        turn = turn[order]
        after = np.append(star[1:], n)
        size = after[turn] - order + 1
        same = np.zeros(len(order), bool)
        like = np.flatnonzero((size[1:] == size[:-1]) & (order[1:] + size[1:] <= n) & (order[:-1] + size[:-1] <= n))
        same[like + 1] = _same(text, order[like], order[like + 1], size[like])
        if same.any():
            names = np.empty(len(star), np.int32 if len(star) < 1 << 31 else np.int64)
            names[turn] = np.cumsum(~same) - 1
            order = np.concatenate([star[p] for p, _ in suffix_order(names, 0, most, scratch)])
        seeds = scratch.hold(order.astype(star.dtype))
    else:
        seeds = star
    prefixes = np.append(np.zeros(min(len(seeds), 1), np.int32), common_prefix(text, seeds[:-1].astype(np.int64), seeds[1:].astype(np.int64), length)) if length else None
    large, up, small, down = both(seeds, prefixes, length)
    l_end, s_end = np.cumsum(np.bincount(text[large], minlength=sigma)), np.cumsum(np.bincount(text[small], minlength=sigma)) if len(small) else np.zeros(sigma, np.int64)
    lo = a = b = 0
    while lo < sigma:
        hi = max(int(np.searchsorted(l_end + s_end, a + b + PIECE, "right")), lo + 1)
        c, d = int(l_end[hi - 1]), int(s_end[hi - 1])
        mine, other = large[a:c].astype(np.int64), small[len(small) - d : len(small) - b][::-1].astype(np.int64)
        place = np.concatenate([mine, other])
        key = np.concatenate([2 * text[mine].astype(np.int64), 2 * text[other].astype(np.int64) + 1])
        order = np.argsort(key, kind="stable")
        common = np.zeros(len(place), np.int32)
        if length:
            # an S suffix has its common prefix with the next larger one
            shifted = np.append(np.zeros(1, np.int32), down[len(small) - d : len(small) - b][::-1][:-1]) if d > b else np.zeros(0, np.int32)
            common = np.concatenate([up[a:c], shifted])
        place, key, common = place[order], key[order], common[order]
        if length and len(key):
            turn = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for k in turn.tolist():
                met = k and key[k] & 1 and key[k - 1] == key[k] - 1
                common[k] = min(_run_length(text, int(place[k - 1]), length), _run_length(text, int(place[k]), length)) if met else 0
        yield place, common
        lo, a, b = hi, c, d
