"""Line dedup across documents through deletion neighbourhoods.

A line is its sequence of words (A-Z lower-cased); each character of a script without spaces is a
word of its own. Lines of ``least`` words or more are kept once: a line goes if an earlier one (by
document id, then place) is equal, or, from NEAR_WORDS words on, lies within an edit distance of one
word (a word put in, left out or replaced). In shorter lines one word is over a fifth of the line.

Near lines are found by joining equal deletion variants. A line emits a hashed key for itself, for
each of its one-word deletions, and for each deletion together with its place (two lines with the
same such key differ by a replaced word). Keys are streamed in order past the earliest line of each
group, so a group of any size costs one link per member and no pairs. Links are verified by the edit
distance of the words. Before that, a lossless sieve drops lines that share neither their first nor
their second half with any other distinct line: one edit leaves one of the halves untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, column, filled, free_names, packed, release, row_key, schema_of, unpacked

LEAST_WORDS, NEAR_WORDS = 5, 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Thai, Lao, Tibetan, Burmese, Khmer, Tai scripts, kana, bopomofo and Han.
_UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNITS = re.compile(f"[{_UNSPACED}]|[^\\x20\\x09-\\x0D{_UNSPACED}]+")
_HIGH_BYTE = re.compile(b"[\xe0-\xf4]")
#: An odd multiplier and its inverse modulo 2**64, for sums that can be moved to any place.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _WordHash(dict):
    """Word -> 64-bit hash; forgets when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 18:
            self.clear()
        self[word] = own = xxhash.xxh64_intdigest(word, 11)
        return own


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Lines:
    """Word hashes of many lines end to end; hashes of any range of words in constant time."""

    def __init__(self, lines: list[list[bytes]], cache: _WordHash):
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        words = np.fromiter((cache[w] for line in lines for w in line), np.uint64, total)
        ones = np.ones(total + 1, np.uint64)
        ones[1:] = BASE
        self.power = np.cumprod(ones)
        ones[1:] = INVERSE
        self.inverse = np.cumprod(ones)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.power[:-1])])

    def range(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a..b (end exclusive, absolute places), equal for equal words wherever they stand."""
        return (self.sum[b] - self.sum[a]) * self.inverse[a]

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, line number, whole): keys of lines, of their one-word deletions, and of deletions with their place."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(line)) - self.start[line]
        at, end = self.start[line] + place, self.start[line] + self.n[line]
        left, right = self.range(self.start[line], at), self.range(at + 1, end)
        gone = left + right * self.power[place]  # the words close up
        size = self.n[line].astype(np.uint64)
        replaced = _mix(gone ^ _mix(size << np.uint64(32) | place.astype(np.uint64) << np.uint64(1) | np.uint64(1)))
        shorter = self.n[line] > NEAR_WORDS
        deleted = _mix(gone ^ _mix(size - np.uint64(1)))
        whole = _mix(self.range(self.start, self.start + self.n) ^ _mix(self.n.astype(np.uint64)))
        key = np.concatenate([replaced, deleted[shorter], whole])
        return key, np.concatenate([line, line[shorter], np.arange(len(self.n))]), np.arange(len(key)) >= len(key) - len(self.n)


def words_of(line: str) -> list[bytes]:
    return line.encode().translate(_LOWER).split()


def units_of(line: bytes) -> list[bytes]:
    """Words of a lower-cased line, those in scripts without spaces taken apart into characters."""
    if _HIGH_BYTE.search(line) is None:
        return line.split()
    return [x.encode() for x in _UNITS.findall(line.decode())]


def line_units(line: str) -> list[bytes]:
    return units_of(line.encode().translate(_LOWER))


def within_one_word(a: list[bytes], b: list[bytes]) -> bool:
    """Edit distance over words of at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


# ---------------------------------------------------------------- distinct lines
def distinct_lines(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_WORDS) -> DataFrame:
    """(h1, h2, n, first(id, row, no), k0..k3): one row per distinct line of ``least`` words, with its earliest place and sieve keys."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_digest, xxh3_128_digest

        def halves(words: list[bytes], base: int) -> bytes:
            """Keys of the first and the second half, as a line of ``base`` words sees them; none for short lines."""
            if base < NEAR_WORDS:
                return b"\0" * 16
            half = base // 2
            return xxh3_64_digest(b" ".join(words[:half]), 4 * base + 1) + xxh3_64_digest(b" ".join(words[half - base :]), 4 * base + 2)

        for batch in batches:
            doc, no, size, digests, keys = [], [], [], [], []
            for i, raw in enumerate(filled(batch.column(2)).cast(pa.large_binary())):
                for j, line in enumerate(raw.as_py().translate(_LOWER).split(b"\n")):
                    words = units_of(line)
                    n = len(words)
                    if n >= least:
                        doc.append(i)
                        no.append(j)
                        size.append(n)
                        digests.append(xxh3_128_digest(b" ".join(words)))
                        # as the shorter line of a pair (or an equally long one), and as the longer one
                        keys.append(halves(words, n) + halves(words, n - 1))
            pick = pa.array(doc, pa.int32())
            h, k = (np.frombuffer(b"".join(x), ">i8").astype(np.int64).reshape(-1, m) for x, m in ((digests, 2), (keys, 4)))
            cols = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(no, pa.int64()), pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in (*h.T, *k.T))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "row", "no", "n", "h1", "h2", "k0", "k1", "k2", "k3"])

    keys = ["k0", "k1", "k2", "k3"]
    found = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("t"))
    found = found.mapInArrow(run, f"id {kind}, row long, no long, n long, h1 long, h2 long, " + ", ".join(f"{k} long" for k in keys))
    # ids that are null come last
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "no")
    best = found.groupBy("h1", "h2").agg(F.min(order).alias("first"), *(F.max(c).alias(c) for c in ["n", *keys]))
    return best.select("n", "first.id", "first.row", "first.no", *keys)


# ---------------------------------------------------------------- near lines
def _shared(lines: DataFrame) -> DataFrame:
    """Distinct lines (id, row, no) that share a sieve key with another one; equal keys pass by in order, whatever their number."""
    rows = lines.filter(F.col("n") >= NEAR_WORDS).select(F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"), "id", "row", "no").filter("key != 0")
    kind = lines.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, which may meet its equal in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = own.column(0).to_numpy()
            same = key[1:] == key[:-1]
            yield own.filter(pa.array(np.append(False, same) | np.append(same, False))).select([1, 2, 3])
            held = own.slice(own.num_rows - 1)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"id {kind}, row long, no long").distinct()


def _links(texts: DataFrame) -> DataFrame:
    """(later, earlier) of lines with equal variant keys; ``texts`` is (r, line), r in the lines' order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for batch in batches:
            r, text = batch.column(0).to_numpy(), batch.column(1)
            for k in range(0, batch.num_rows, 1024):
                key, line, whole = Lines([line_units(x.as_py()) for x in text.slice(k, 1024)], cache).variants()
                # a whole line stands before the deletions that equal it
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(np.where(whole, 0, 1).astype(np.int8)), _long(r[k : k + 1024][line])], ["key", "role", "r"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, 1, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, role, r = (c.to_numpy() for c in batch.columns)
            new = np.append(True, key[1:] != key[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            top, top_role = r[head], role[head]
            if key[0] == held[0]:
                top, top_role = np.where(head == 0, held[2], top), np.where(head == 0, held[1], top_role)
            held = (key[-1], top_role[-1], top[-1])
            yield pa.RecordBatch.from_arrays([_long(np.maximum(r, top)[r != top]), _long(np.minimum(r, top)[r != top])], ["later", "earlier"])

    keys = texts.mapInArrow(emit, "key long, role byte, r long")
    return keys.repartition("key").sortWithinPartitions("key", "role", "r").mapInArrow(pair, "later long, earlier long").distinct()


def near_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, no) of distinct lines within one word of an earlier one."""
    kind = docs.schema[id_col].dataType.simpleString()
    some = checkpointed(_shared(lines))
    ranked = checkpointed(some.orderBy(F.col("id").isNull(), "id", "row", "no").withColumn("r", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    wanted = ranked.groupBy("id", "row").agg(F.collect_list(F.struct("no", "r")).alias("wanted"))
    own = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__row"), F.col(text_col).alias("t"))
    met = wanted.join(own, (F.col("row") == F.col("__row")) & F.col("id").eqNullSafe(F.col("__id"))).select("wanted", F.split("t", "\n", -1).alias("l"))
    texts = checkpointed(met.select("l", F.explode("wanted").alias("w")).select("w.r", F.get("l", F.col("w.no").cast("int")).alias("line")).dropDuplicates(["r"]))
    release(docs.sparkSession)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one_word(line_units(a), line_units(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0])

    links = _links(texts)
    both = links.join(texts.withColumnsRenamed({"r": "later", "line": "a"}), "later").join(texts.withColumnsRenamed({"r": "earlier", "line": "b"}), "earlier")
    gone = both.select("later", "a", "b").mapInArrow(verify, "later long").distinct()
    return ranked.join(gone, ranked.r == gone.later, "left_semi").select(F.col("id").cast(kind).alias("id"), "row", "no")


# ---------------------------------------------------------------- operator
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: id, ``keep``..., text without the lines dropped, n_lines, n_dropped.

    Lines under ``least`` words always stay. A null text stays null with 0 lines, an empty one is one empty line; ids that are null count as last.
    Documents of one id with different texts come in the order of their row hashes. Repeated rows (same id and text) are one document and come
    out alike; an empty table gives no rows. Texts of any length are read whole, row by row. The order of the remaining lines does not change.
    Columns other than those named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    lines = checkpointed(distinct_lines(docs, id_col, text_col, least))
    release(spark)
    near = checkpointed(near_lines(docs, lines, id_col, text_col))
    release(spark)
    same = (lines.row == near.row) & lines.id.eqNullSafe(near.id) & (lines.no == near.no)
    names = [id_col, *keep, text_col]
    stays_at, id_at, row_at, key_at = free_names(docs.select(*map(column, names)), "stays", "id_", "row_", "key_")
    stay = lines.join(near, same, "left_anti").groupBy(F.col("id").alias(id_at), F.col("row").alias(row_at)).agg(F.collect_list("no").alias(stays_at))
    own = docs.select(*map(column, names), row_key(id_col, text_col).alias(key_at))
    met = own.join(stay, (F.col(key_at) == F.col(row_at)) & column(id_col).eqNullSafe(F.col(id_at)), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            for text, nos in zip(batch.column(len(keep) + 1), batch.column(len(keep) + 2), strict=True):
                own = text.as_py()
                if own is None:
                    out.append(None), n_lines.append(0), n_dropped.append(0)
                    continue
                split, stays = own.split("\n"), set(nos.as_py() or ())
                left = [x for i, x in enumerate(split) if i in stays or len(line_units(x)) < least]
                out.append("\n".join(left)), n_lines.append(len(split)), n_dropped.append(len(split) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep) + 1], pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [id_col, *keep, text_col, "n_lines", "n_dropped"],
            )

    return met.select(*names, stays_at).mapInArrow(cut, schema_of(docs, names, "n_lines long, n_dropped long"))


def drop_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """``docs`` (all columns) with texts from dedup_lines(); n_chars follows, where there is such a column. A document that had words and has none left goes;
    documents that lose no line, null and empty texts among them, are unchanged."""
    own = packed(docs, "doc_id", "text")
    found = dedup_lines(own, keep=("own",), least=least).filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("own.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*unpacked(docs, fresh))
