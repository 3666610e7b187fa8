"""Cross-tokenizer alignment: which tokens of one tokenizer share bytes with which tokens of another.

Both encodings of a text are token-byte incidence matrices A and B in compressed sparse rows, built by hand: a row per token, a column per
byte. The product A·Bᵀ, by Gustavson's row method, has an entry wherever two tokens share bytes; its value is how many. Offsets at which
tokens of both end cut the text into groups, whose incidence matrices G give the links inside a group as G_A·G_Bᵀ. Matrices are made for a
slab of text at a time, cut where both tokenizers end a token, so that no text is too long for them.

What a task returns of a document are its sums and each of its id pairs once; pairs are counted over the corpus by a partially aggregated
sum and met again by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, column, filled, schema_of, text_slices
from .tokens import _GAP, LONG_GAP, PATTERN

#: The usual places of the public vocabularies. Every machine has them at the same path.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text encoded at a time, and of a slab of the matrices (more only where a group is larger).
SLICE_BYTES, SLAB_BYTES = 2 << 20, 1 << 20
#: A pair of ids as one number: a · 2^B_BITS + b.
B_BITS = 20
#: Rows of pair counts that may be broadcast (about 40 bytes each); beyond, they are joined by a shuffle.
BROADCAST_PAIRS = 1 << 20


class Vocabulary(NamedTuple):
    """Bytes of every id: those of id i are flat[start[i] : start[i] + size[i]]."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _vocabulary(tokens: list[bytes]) -> Vocabulary:
    size = np.array([len(t) for t in tokens], np.int64)
    return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the other bytes in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """(encode(text) -> ids as an array, Vocabulary) of a byte-level vocabulary whose ids are in the order of its merges (checked); once per worker.

    Special tokens are left out, so that their strings are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held["added_tokens"] if t["special"]}
    letters, vocabulary = byte_letters(), held["model"]["vocab"]
    ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
    places = [vocabulary[a + b] for a, b in merges]
    if places != sorted(places):
        raise ValueError(f"{path}: ids are not in the order of merges")
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    encode, gaps = (partial(tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy, disallowed_special=()) for p in (PATTERN, r"\s+"))

    def ids(text: str) -> np.ndarray:
        if len(text) <= LONG_GAP:
            return encode(text)
        out, at = [], 0  # a long run of white space is encoded by itself but for its last character, which goes with what follows
        for m in re.finditer(f"{_GAP}{{{LONG_GAP},}}", text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            out += [encode(text[at : m.start()]), gaps(text[m.start() : stop])]
            at = stop
        return np.concatenate([*out, encode(text[at:])])

    return ids, _vocabulary(tokens)


@lru_cache(maxsize=2)
def piece_encoder(path: str):
    """(encode(texts) -> lists of ids, Vocabulary) of a sentence-piece model; once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return (lambda texts: model.encode(texts, num_threads=1)), _vocabulary(tokens)


def spelled(ids: np.ndarray, words: Vocabulary) -> np.ndarray:
    """The bytes of all ids end to end."""
    size = words.size[ids]
    ends = np.cumsum(size)
    return words.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start[ids] - ends + size, size)]


# ---------------------------------------------------------------- sparse matrices
class Rows(NamedTuple):
    """A 0/1 matrix in compressed sparse rows: the columns of row i are columns[at[i] : at[i + 1]], ascending."""

    at: np.ndarray
    columns: np.ndarray
    width: int


def token_bytes(ends: np.ndarray) -> Rows:
    """Tokens by bytes, of tokens that end at ``ends`` and follow one another from byte 0 on."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.concatenate([[0], ends]), np.arange(n), n)


def token_groups(group: np.ndarray, n: int) -> Rows:
    """Tokens by groups: each token is in one."""
    return Rows(np.arange(len(group) + 1), group, n)


def transposed(m: Rows) -> Rows:
    rows = np.repeat(np.arange(len(m.at) - 1), np.diff(m.at))
    count = np.bincount(m.columns, minlength=m.width)
    return Rows(np.concatenate([[0], np.cumsum(count)]), rows[np.argsort(m.columns, kind="stable")], len(m.at) - 1)


def row_sizes(a: Rows, bt: Rows) -> np.ndarray:
    """Entries that each row of the product meets, repeats included (Gustavson's symbolic pass)."""
    met = np.concatenate([[0], np.cumsum(np.diff(bt.at)[a.columns])])
    return met[a.at[1:]] - met[a.at[:-1]]


def product(a: Rows, bt: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a·b, where ``bt`` has the rows of b that a's columns name: for each row of a those rows of b are
    brought together and equal columns summed. Entries come by row, then column."""
    take = np.diff(bt.at)[a.columns]
    ends = np.cumsum(take)
    n = int(ends[-1]) if len(ends) else 0
    row = np.repeat(np.repeat(np.arange(len(a.at) - 1), np.diff(a.at)), take)
    key = row * bt.width + bt.columns[np.arange(n) + np.repeat(bt.at[:-1][a.columns] - ends + take, take)]
    if np.any(key[1:] < key[:-1]):
        key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    row, col = np.divmod(key[first], max(bt.width, 1))
    return row, col, np.diff(np.concatenate([first, [n]]))


# ---------------------------------------------------------------- one batch of texts
class Side(NamedTuple):
    """Tokens of a batch end to end: ids, byte ends, and where the tokens of each text begin (one more at the end)."""

    ids: np.ndarray
    ends: np.ndarray
    at: np.ndarray


def _side(ids: np.ndarray, sizes: list[int], words: Vocabulary) -> Side:
    return Side(ids, np.cumsum(words.size[ids]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))


def _spells(side: Side, words: Vocabulary, wanted: list[bytes]) -> np.ndarray:
    """Of each text: do its tokens spell it?"""
    said = spelled(side.ids, words)
    cuts = np.concatenate([[0], side.ends])[side.at]
    if said.tobytes() == b"".join(wanted) and np.array_equal(np.diff(cuts), [len(w) for w in wanted]):
        return np.ones(len(wanted), bool)
    return np.array([said[lo:hi].tobytes() == w for lo, hi, w in zip(cuts[:-1], cuts[1:], wanted, strict=True)], bool)


def encoded(texts: list[str], paths: tuple[str, str]) -> tuple[Side, Side]:
    """Both encodings of space + text of each text; no tokens where a text is empty or either encoding does not spell it."""
    (encode_a, words_a), (encode_b, words_b) = byte_encoder(paths[0]), piece_encoder(paths[1])
    spaced = [f" {t}" if t else "" for t in texts]
    lists_a, lists_b = [encode_a(t) for t in spaced], encode_b(texts) if texts else []
    sides = (
        _side(np.concatenate([*lists_a, np.zeros(0, np.int64)]).astype(np.int64), [len(x) for x in lists_a], words_a),
        _side(np.fromiter(chain.from_iterable(lists_b), np.int64, sum(map(len, lists_b))), [len(x) for x in lists_b], words_b),
    )
    wanted = [t.encode() for t in spaced]
    good = _spells(sides[0], words_a, wanted) & _spells(sides[1], words_b, wanted)
    if good.all():
        return sides
    return tuple(
        _side(s.ids[np.repeat(good, np.diff(s.at))], np.where(good, np.diff(s.at), 0), words) for s, words in zip(sides, (words_a, words_b), strict=True)
    )


class Slab(NamedTuple):
    """A run of whole groups: tokens of both sides from-to, and its links (token, token, shared bytes), places counted over the batch."""

    links_a: np.ndarray
    links_b: np.ndarray
    shared: np.ndarray
    group_links: np.ndarray  # of each A token: B tokens in its group
    first_a: int


def slabs(a: Side, b: Side, both: np.ndarray, slab_bytes: int) -> Iterator[Slab]:
    """The products of a batch, slab by slab; ``both`` are the byte offsets at which tokens of both sides end."""
    cuts = both[np.unique(np.concatenate([np.searchsorted(both, np.arange(slab_bytes, both[-1] if len(both) else 0, slab_bytes)), [len(both) - 1]]))] if len(both) else both
    start = 0
    for stop in cuts:
        (a0, a1), (b0, b1) = (np.searchsorted(s.ends, [start, stop], side="right") for s in (a, b))
        ends_a, ends_b = a.ends[a0:a1] - start, b.ends[b0:b1] - start
        i, j, shared = product(token_bytes(ends_a), transposed(token_bytes(ends_b)))
        inside = both[np.searchsorted(both, start, side="right") : np.searchsorted(both, stop, side="right")] - start
        group_a, group_b = (token_groups(np.searchsorted(inside, e), len(inside)) for e in (ends_a, ends_b))
        yield Slab(i + a0, j + b0, shared, row_sizes(group_a, transposed(group_b)), int(a0))
        start = stop


@lru_cache(maxsize=2)
def _decimals(n: int) -> np.ndarray:
    """Id texts with what may follow them: comma, bar, semicolon."""
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], object)


def group_texts(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, n_ids: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups in order."""

    def marks(group: np.ndarray, last: int) -> np.ndarray:
        return np.where(np.concatenate([group[1:] != group[:-1], [True]]), last, 0) if len(group) else group

    words = np.concatenate([a.ids + n_ids * marks(group_a, 1), b.ids + n_ids * marks(group_b, 2)])
    # A's tokens of a group come before B's: each token's place is its place on its side plus what the other side has put before it
    places = np.concatenate([np.arange(len(group_a)) + np.searchsorted(group_b, group_a, side="left"), np.arange(len(group_b)) + np.searchsorted(group_a, group_b, side="right")])
    ordered = np.empty(len(words), np.int64)
    ordered[places] = words
    said = _decimals(n_ids)[ordered].tolist()
    at = a.at + b.at
    return ["".join(said[lo:hi])[:-1] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _align_batch(texts: list[str], paths: tuple[str, str], slab_bytes: int) -> dict[str, list]:
    a, b = encoded(texts, paths)
    both = np.intersect1d(a.ends, b.ends, assume_unique=True)
    group_a, group_b = (np.searchsorted(both, s.ends) for s in (a, b))
    n = len(texts)
    doc_a = np.repeat(np.arange(n), np.diff(a.at))
    n_links, n_shared = np.zeros(n, np.int64), np.zeros(n, np.int64)
    keys = []
    for slab in slabs(a, b, both, slab_bytes):
        doc = doc_a[slab.links_a]
        n_links += np.bincount(doc, minlength=n)
        n_shared += np.bincount(doc_a[slab.first_a : slab.first_a + len(slab.group_links)], slab.group_links, n).astype(np.int64)
        keys.append((doc << 44) | (a.ids[slab.links_a] << B_BITS) | b.ids[slab.links_b])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    pair_at = np.searchsorted(keys[first], np.arange(n + 1) << 44)
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(pair_at.astype(np.int32)), pa.array(x, kind))
    ends = np.concatenate([[0], a.ends])[a.at]
    said = group_texts(a, b, group_a, group_b, 1 << 16)
    return {
        "n_a": np.diff(a.at),
        "n_b": np.diff(b.at),
        "n_groups": np.diff(np.searchsorted(both, ends, side="right")),
        "n_links": n_links,
        "n_group_links": n_shared,
        "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said],
        "pairs": lists(keys[first] & ((1 << 44) - 1), pa.int64()),
        "times": lists(times, pa.int32()),
    }


SUMS = "n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECE_BPE), slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Per document: the id, n_a and n_b (tokens), n_groups, n_links (token pairs that share bytes), n_group_links (token pairs of one
    group), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, ids in order), and ``pairs`` (a·2^20 + b, each once) with ``times`` (its links).

    Null and empty texts, and texts that an encoding does not spell, have no tokens: zeros, empty text and lists. Repeated rows come out
    alike, an empty table gives none, other columns are ignored. Texts are encoded whole; matrices are made slab by slab.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for lo, hi in text_slices(texts, SLICE_BYTES):
                found = _align_batch(texts[lo:hi].to_pylist(), paths, slab_bytes)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(v if isinstance(v, pa.Array) else pa.array(v) for v in found.values())], names=names)

    names = [id_col, *SUMS.replace(",", "").split()[::2]]
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, schema_of(docs, [id_col], SUMS))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECE_BPE), slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """All links in long form: the id, a_at and b_at (places of the tokens in their encodings), a_id, b_id, shared_bytes. Rules as for align()."""
    bounded_batches(docs.sparkSession)
    more = "a_at long, b_at long, a_id long, b_id long, shared_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for lo, hi in text_slices(texts, SLICE_BYTES):
                a, b = encoded(texts[lo:hi].to_pylist(), paths)
                doc_a = np.repeat(np.arange(hi - lo), np.diff(a.at))
                for s in slabs(a, b, np.intersect1d(a.ends, b.ends, assume_unique=True), slab_bytes):
                    doc = doc_a[s.links_a]
                    own = batch.column(0)[lo:hi].take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(x) for x in (s.links_a - a.at[doc], s.links_b - b.at[doc], a.ids[s.links_a], b.ids[s.links_b], s.shared))], names=names)

    names = [id_col, *more.replace(",", "").split()[::2]]
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, schema_of(docs, [id_col], more))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best): in how many documents of align() an id pair is linked; best tells whether no pair of its A id is in more."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = counted.select("pair", F.shiftright("pair", B_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b_id"), "n_docs")
    most = F.max("n_docs").over(Window.partitionBy("a_id"))  # at most a vocabulary of rows
    return counted.withColumn("best", F.col("n_docs") == most)


def alignment_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECE_BPE), broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """align() without its lists, with n_best (links whose pair is the best of its A id over the corpus, ties included) and count_sum (the
    documents that hold a link's pair, summed over links). Encoded once: sums and pairs are kept in the shared folder."""
    held = checkpointed(align(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "doc_id", "text", paths).withColumn("row", F.monotonically_increasing_id()))
    counts = checkpointed(pair_counts(held).select("pair", "n_docs", "best"))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    met = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times")).join(counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = held.drop("pairs", "times").join(sums, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), *SUMS.replace(",", "").split()[::2][:5], F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
