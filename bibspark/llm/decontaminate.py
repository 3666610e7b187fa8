"""Benchmark decontamination by an FM-index per training shard.

Texts become sequences over the alphabet of the benchmark's words; runs too short to hold any test
phrase, and words that no phrase has, cannot take part in a match and leave only a separator. Every
shard of sequences gets an FM-index: suffix order by doubling, Burrows-Wheeler transform in a wavelet
matrix with rank directories, and sampled suffix positions. All phrases are searched backward at
once, their occurrences located by walking to the nearest sample, and the spans merged per document.

Shards are slices of Arrow batches: the pass over the texts is narrow, without a shuffle. The
benchmark travels in blocks of at most BLOCK_WORDS words, each made into arrays once and broadcast;
each further block is one more narrow pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, column, filled, free_names, packed, schema_of, text_slices, unpacked

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Fixed value: words of an item's windows.
WINDOW = 10
SHARD_BYTES, SAMPLE_RATE = 4 << 20, 8
#: Words of benchmark text in one block of phrases: a broadcast of at most 64 bytes a word, 64 MB in all.
BLOCK_WORDS = 1_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.translate(_TABLE).split()


class Phrases:
    """Distinct windows of some benchmark items over an alphabet of their words (numbers from 1), as arrays.

    ``words`` holds the windows right-aligned for backward search, ``owner`` the items of window k at ``at[k]`` to ``at[k + 1]``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.items = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        sizes = np.fromiter((len(words) for _, words in items), np.int64, len(items))
        flat = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for _, words in items for w in words), np.int32, int(sizes.sum()))
        count = np.where(sizes > 0, np.maximum(sizes - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        first = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(sizes[item], window)
        place = first[:, None] + np.arange(window) - (window - length)[:, None]
        rows = np.where(place >= first[:, None], flat[np.maximum(place, 0)] if len(flat) else 0, 0).astype(np.int32)
        order = np.lexsort((item, *rows.T[::-1]))
        rows, item, length = rows[order], item[order], length[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(rows) else np.zeros(0, bool)
        own = new | np.append(True, item[1:] != item[:-1]) if len(rows) else new  # an item counts once per window
        self.words, self.length = rows[new], length[new]
        self.owner, self.at = item[own], np.append(np.flatnonzero(new[own]), own.sum())
        self.shortest = int(self.length.min()) if len(self.length) else 0

    def owners(self, phrases: np.ndarray) -> set[str]:
        return {self.items[k] for p in np.unique(phrases).tolist() for k in self.owner[self.at[p] : self.at[p + 1]].tolist()}


class WaveletMatrix:
    """Rank queries over a sequence of numbers; one bit vector with a prefix count per binary digit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            one = (values >> b & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]))
            self.zeros.append(len(values) - int(self.ranks[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at
        for level, b in enumerate(reversed(range(self.bits))):
            ones, zeros, bit = self.ranks[level], self.zeros[level], (symbol >> b & 1).astype(bool)
            lo1, hi1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Of a sequence of numbers >= 0, in which 0 separates; a closing 0 is added. Neither search nor locate ever steps over a separator."""

    def __init__(self, text: np.ndarray, rate: int = SAMPLE_RATE):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank = self._names(text[order], order)
        step = 1
        while int(rank.max()) < n - 1:
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            rank = self._names(key[order], order)
            step *= 2
        self.bwt, self.text, self.n = text[order - 1], text, n
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.matrix = WaveletMatrix(self.bwt, max(1, int(text.max()).bit_length()))
        self.sampled = np.where((order % rate == 0) | (self.bwt == 0), order, -1)  # run starts too: the walk ends there

    @staticmethod
    def _names(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        names = np.zeros(len(keys), np.int64)
        names[order] = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        return names

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: places of the suffixes that begin with the symbol, then with what stands before ``at``."""
        return self.less[symbol] + self.matrix.rank(symbol, at)

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of right-aligned phrases; empty ones are dropped from the search as soon as they are empty."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        live = np.arange(len(words))
        for k in range(words.shape[1]):
            live = live[(lo[live] < hi[live])]
            now = live[length[live] > k]
            symbol = words[now, words.shape[1] - 1 - k]
            absent = symbol >= len(self.less) - 1
            hi[now[absent]] = lo[now[absent]]
            now, symbol = now[~absent], symbol[~absent]
            if not len(now):
                break
            lo[now], hi[now] = self.step(symbol, lo[now]), self.step(symbol, hi[now])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of places in suffix order, by backward steps to sampled ones."""
        out, walked, todo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(todo):
            known = self.sampled[at[todo]]
            done = known >= 0
            out[todo[done]] = known[done] + walked[todo[done]]
            todo = todo[~done]
            symbol = self.bwt[at[todo]]
            at[todo] = self.step(symbol, at[todo])
            walked[todo] += 1
        return out


class Shard:
    """Word numbers of some texts, cut down to the runs that can hold a phrase."""

    def __init__(self, texts: list[bytes], phrases: Phrases):
        number = phrases.number.get
        self.n_words = np.zeros(len(texts), np.int64)
        parts, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, text in enumerate(texts):
            own = words_of(text)
            self.n_words[i] = len(own)
            parts.append(np.fromiter((number(w, 0) for w in own), np.int64, len(own)))
            parts.append(np.zeros(1, np.int64))
        starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        whole = np.concatenate(parts)
        # runs of known words, each with the separator behind it; short ones go
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        fits = b - a >= max(phrases.shortest, 1)
        a, b = a[fits], b[fits]
        size = b - a + 1
        self.at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())  # place in the whole of each symbol kept
        self.text = whole[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.starts = starts

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first word, phrase) of all occurrences."""
        none = np.zeros(0, np.int64)
        if not len(self.text) or not len(phrases.length):
            return none, none, none
        index = FMIndex(self.text)
        lo, hi = index.search(phrases.words, phrases.length)
        found = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(lo)), found)
        place = np.repeat(lo - (np.cumsum(found) - found), found) + np.arange(found.sum())
        at = self.at[index.locate(place)]
        doc = np.searchsorted(self.starts, at, "right") - 1
        return doc, at - self.starts[doc], phrase


def phrase_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items with words, read row by row, in blocks of bounded size."""
    block, held = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if words:
            block.append(("" if row[0] is None else str(row[0]), words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS, then: tuple[Pass, T.StructType] | None = None) -> DataFrame:
    """One row per document: id, ``keep``..., n_words, n_hit, n_items, items_sha256, contaminated, spans (merged ``first:end`` word ranges), items.

    Null and empty texts have no words. Items without words never match; rows of one item_id count as one item, a null item_id as the empty name.
    An empty benchmark leaves every document clean, an empty table gives no rows. Repeated rows give repeated results. A text of any length is
    one sequence of its shard and read whole. Of several occurrences that overlap or tie, all count. Columns other than those named are ignored,
    whatever their names. ``then`` is a further pass over these rows, with the schema of what it gives; it runs in the same worker.
    """
    bounded_batches(docs.sparkSession)
    names = [id_col, *keep]
    whole, number, cuts, found = free_names(docs.select(*map(column, names)), "text_", "n_words_", "edges_", "items_")
    state = docs.select(
        *map(column, names), column(text_col).alias(whole), F.lit(None).cast("long").alias(number), F.array().cast("array<long>").alias(cuts), F.array().cast("array<string>").alias(found)
    )

    def search(block: list[tuple[str, list[bytes]]]):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block))  # at most BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                texts = filled(batch.column(len(names)))
                n_words, edges, items = [], [], []
                before = list(zip(batch.column(len(names) + 2).to_pylist(), batch.column(len(names) + 3).to_pylist(), strict=True))
                for a, b in text_slices(texts, SHARD_BYTES):
                    shard = Shard([x.as_py() for x in texts.slice(a, b - a).cast(pa.large_binary())], phrases)
                    doc, first, phrase = shard.occurrences(phrases)
                    order = np.argsort(doc, kind="stable")
                    cut = np.searchsorted(doc[order], np.arange(b - a + 1))
                    for i in range(b - a):
                        own = order[cut[i] : cut[i + 1]]
                        old_edges, old_items = before[a + i]
                        n_words.append(int(shard.n_words[i]))
                        if len(own):
                            starts = np.concatenate([np.array(old_edges[::2], np.int64), first[own]])
                            ends = np.concatenate([np.array(old_edges[1::2], np.int64), first[own] + phrases.length[phrase[own]]])
                            edges.append(merged(starts, ends))
                            items.append(sorted({*old_items, *phrases.owners(phrase[own])}))
                        else:
                            edges.append(old_edges)
                            items.append(old_items)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names) + 1], pa.array(n_words, pa.int64()), pa.array(edges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    [*names, whole, number, cuts, found],
                )

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, edges, items = (batch.column(len(names) + 1 + k).to_pylist() for k in range(3))
            hit = [sum(e[1::2]) - sum(e[::2]) for e in edges]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array(n_words, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                    pa.array([",".join(f"{s}:{t}" for s, t in zip(e[::2], e[1::2], strict=True)) for e in edges], pa.string()),
                    pa.array(items, pa.list_(pa.string())),
                ],
                [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )

    schema = schema_of(docs, names, f"{whole} string, {number} long, {cuts} array<long>, {found} array<string>")
    shown = schema_of(docs, names, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string, items array<string>")
    after, result = then or (None, shown)
    last: list[tuple[str, list[bytes]]] = []
    for block in phrase_blocks(benchmark, item_col, item_text_col, block_words):
        if last:
            state = state.mapInArrow(search(last), schema)
        last = block
    last_search = search(last)

    def finally_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last block's search and all that follows: one worker per task, which texts enter once."""
        for step in (last_search, finish, after):
            batches = step(batches) if step else batches
        return batches

    return state.mapInArrow(finally_, result)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Union of ranges as [start, end, start, end...] in order; touching ranges join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)
    return np.stack([starts[new], ends[last]], axis=1).ravel().tolist()


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the words of all removal spans cut out of the texts (n_chars follows, where there is such a column).

    A document of which no word is left goes; clean rows, null and empty texts among them, are unchanged, repeated rows as often as they come.
    """
    bounded_batches(docs.sparkSession)
    own = packed(docs, "text").select("own", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit = batch.column(2), batch.column(3)
            batch = batch.filter(pc.or_(pc.equal(n_hit, 0), pc.less(n_hit, n_words)))
            texts, spans = batch.column(1), batch.column(7).to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                mask = np.zeros(len(spans), bool)
                mask[hit] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([cut_words(texts[i].as_py(), spans[i]) for i in hit], texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["own", "text"])

    kept = find_leaks(own, benchmark, id_col="own", keep=("text",), then=(cut, schema_of(own, ["own", "text"], "")))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long"))}
    return kept.select(*unpacked(docs, fresh))


def cut_words(text: str, spans: str) -> str:
    """The text without the words of the spans, from the start of a span's first word to the end of its last."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    a, b, parts, at = edge[::2], edge[1::2], [], 0
    for span in spans.split(","):
        first, end = map(int, span.split(":"))
        parts.append(raw[at : a[first]])
        at = int(b[end - 1])
    return b"".join([*parts, raw[at:]]).decode()
