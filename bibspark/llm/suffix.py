"""Suffix-array dedup: bytes covered by a repeated string of LENGTH bytes are removed.

Repeats cross shards, so texts are first dealt out by content: of each LENGTH-byte window the place
with the least rolling hash is its anchor, and equal windows have equal anchors at equal offsets.
All windows of one anchor stand in one context (a stretch of text around it). An anchor that comes
once has nothing to remove; a context that comes twice is removed as a whole; what is left -
different contexts around one anchor, at the ends of repeated passages and around edits - goes to
shards by anchor, one copy per different context. Anchors with very many different contexts are dealt
out once more, by the least of another hash in each window.

Windows that no other context can share are left out without loss: windows begin in one of PARTS ranges
before their anchor, all those of a range have most of their bytes in common, and a context that shares
these with no other one of its anchor has no repeat in that range. A shard's contexts are one text,
put in suffix order by external induced sorting (see induced.py); suffixes between which all common
prefixes reach LENGTH bytes are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, bytes_of, checkpointed, column, filled, free_names, release, row_key, schema_of, text_slices
from .induced import QUEUED, suffix_order

LENGTH = 200
#: Bytes of an anchor (less for short windows); the least of LENGTH - GRAM + 1 hashes is the anchor of a window. Multipliers of the two hashes.
GRAM, FIRST, SECOND = 32, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Least bytes of one sorted shard: many times what the sorter's queues hold in memory.
SHARD_BYTES = 2 << 20
#: Different contexts of one anchor from which on they are dealt out once more.
MANY_CONTEXTS = 1 << 13
BLOCK_BYTES = 1 << 20
#: Ranges of window starts before an anchor, by which contexts are sieved.
PARTS = 16
#: Rows among which a task looks for equal anchors before they are dealt out, and what it then knows of a row: others are as it is, or it stands for others.
HELD_ROWS, KNOWN, STANDS = 1 << 18, 1, 2
#: Bits that hold how far a context's anchor is from its start; the number of its further windows stands above them. Both are under the length.
MORE_BITS = 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SEED)


def rolling(data: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on (a power of two, by doubling)."""
    h, m, step = _BYTE[data], base, 1
    while step < size:
        h = h[:-step] * np.uint64(m) + h[step:]
        m, step = m * m % (1 << 64), step * 2
    return h


def _slide(x: np.ndarray, size: int, of=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of ``size`` values from every place on."""
    step = 1
    while step * 2 <= size:
        x, step = of(x[:-step], x[step:]), step * 2
    rest = size - step
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, base: int = FIRST) -> tuple[np.ndarray, ...]:
    """(text, hash, place, first window, last window) of each anchor of the texts that end at ``at``; the windows from first to last have it.

    A window's anchor is the first place with the least hash in it: a function of the window's content alone.
    """
    none = np.zeros(0, np.int64)
    gram = min(GRAM, 1 << length.bit_length() - 1)
    n, span = len(data), length - gram + 1
    own = np.flatnonzero(np.diff(at) >= length)
    if not len(own):
        return none, none.view(np.uint64), none, none, none
    h = _mix(rolling(data, gram, base))
    least = _slide(h, span) if span > 1 else h.copy()
    edge = np.zeros(len(least) + 1, np.int8)
    edge[at[own]] += 1
    edge[at[own + 1] - length + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0  # windows inside one text; those of two texts never adjoin
    least[~valid] = 0
    pad = np.zeros(span - 1, np.uint64)
    cover = _slide(np.concatenate([pad, least, pad]), span, np.maximum)
    where = np.flatnonzero((h == cover) & (cover > 0))
    order = np.lexsort((where, h[where]))
    value, place = h[where][order], where[order]
    rank = np.cumsum(np.append(0, value[1:] != value[:-1]))
    key = rank * np.int64(n) + place
    first = np.flatnonzero(valid & np.append(True, (least[1:] != least[:-1]) | ~valid[:-1]))
    last = np.flatnonzero(valid & np.append((least[1:] != least[:-1]) | ~valid[1:], True))
    mine = rank[np.searchsorted(value, least[first])]
    out = []
    while len(first):  # the windows of one least value, cut where the value's first place falls out of the window
        p = place[np.searchsorted(key, mine * np.int64(n) + first)]
        out.append((h[p], p, first, np.minimum(last, p)))
        more = p < last
        first, last, mine = p[more] + 1, last[more], mine[more]
        if len(out) == 16 and len(first):  # long runs of one hash: the places of all their windows at once
            size = last - first + 1
            mine = np.repeat(mine, size)
            window = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(mine))
            p = place[np.searchsorted(key, mine * np.int64(n) + window)]
            new = np.append(True, (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1))
            first = np.flatnonzero(new)
            out.append((h[p[first]], p[first], window[first], window[np.append(first[1:], len(p)) - 1]))
            break
    hashes, places, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(at, lo, "right") - 1
    return text, hashes, places - at[text], lo - at[text], hi - at[text]


def repeated(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, most: int = QUEUED) -> np.ndarray:
    """Of the places ``starts`` (whose strings of ``length`` bytes lie inside one context), those whose string also starts at another of them."""
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    held, found = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    for place, common in suffix_order(text, length, most):
        group = np.cumsum(common < length)  # 0 goes on with the last one of the piece before
        own = valid[place]
        group, place, last = np.append(np.zeros(len(held), np.int64), group[own]), np.append(held, place[own]), int(group[-1])
        several = np.bincount(group, minlength=last + 1)[group] > 1
        found.append(place[several & (group < last)])
        held = place[group == last]
    if len(held) > 1:
        found.append(held)
    return np.sort(np.concatenate(found))


# ---------------------------------------------------------------- distributed part
def _contexts(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(anchor, context, id, row, lo, at): each anchor with a digest of its context. ``lo`` is the first window, ``at`` packs the number of further ones and
    the anchor's distance, both of which are bounded by the window's length; the start is not."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_digest
        for batch in batches:
            texts = filled(batch.column(2))
            for a, b in text_slices(texts, BLOCK_BYTES):
                data, at = bytes_of(texts.slice(a, b - a))
                text, h, place, lo, hi = anchors(data, at, length)
                if not len(h):
                    continue
                raw, base = data.tobytes(), at[text]
                own = b"".join([digest(raw[x:y], p) for x, y, p in zip((base + lo).tolist(), (base + hi + length).tolist(), (place - lo).tolist(), strict=True)])
                pick = pa.array(text + a)
                cols = [pa.array(h.view(np.int64)), pa.array(np.frombuffer(own, ">i8").astype(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(lo), pa.array((hi - lo) << MORE_BITS | place - lo)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "context", "id", "row", "lo", "at"])

    own = docs.select(column(id_col).alias("id"), row_key(id_col, text_col).alias("row"), column(text_col).alias("t"))
    return own.mapInArrow(run, T.StructType([*T.StructType.fromDDL("anchor long, context long").fields, *schema_of(own, ["id"], "row long, lo long, at long").fields]))


def _several(rows: DataFrame) -> DataFrame:
    """Rows whose anchor comes more than once. Of the rows with one anchor among HELD_ROWS of a task only one, which stands for them, goes to the anchor's
    partition; the others are known to come twice and are dealt out evenly. So no anchor, however frequent, fills a partition."""
    names = rows.columns

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = own.column(0).to_numpy()
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            state, deal = np.zeros(len(key), np.int8), key.copy()
            state[order[np.append(same, False)]] = STANDS
            state[order[np.append(False, same)]] = KNOWN
            known = np.flatnonzero(state == KNOWN)
            deal[known] = _mix(key[known].view(np.uint64) + known.astype(np.uint64) * _SEED).view(np.int64)
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(deal), pa.array(state)], [*names, "deal", "state"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                yield flush()
                held.clear()
        if sum(x.num_rows for x in held):
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, with whether it has met its equal
        met = False
        for batch in batches:
            known = pa.array(batch.column(len(names) + 1).to_numpy() == KNOWN)
            yield batch.filter(known).select(names)
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            own = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = own.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.append(met, same) | np.append(same, False) | (own.column(len(names) + 1).to_numpy() == STANDS)
            yield own.slice(0, own.num_rows - 1).filter(pa.array(keep[:-1])).select(names)
            held, met = own.slice(own.num_rows - 1), bool(keep[-1])
        if held is not None and met:
            yield held.select(names)

    dealt = rows.mapInArrow(combine, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("deal long, state tinyint").fields]))
    return dealt.repartition("deal").sortWithinPartitions("deal", "anchor").mapInArrow(run, rows.schema)


def _cut_to_repeats(rows: pa.Table, length: int) -> pa.Table:
    """Contexts that share, with another one of their anchor, the bytes common to all windows that begin in one of PARTS ranges before the anchor, cut to
    the windows from the first such range to the last."""
    from xxhash import xxh3_64_intdigest

    span = length - min(GRAM, 1 << length.bit_length() - 1)
    edge = [i * (span + 1) // PARTS for i in range(PARTS + 1)]
    anchor, off, lo = (rows.column(x).to_numpy() for x in ("anchor", "off", "lo"))
    texts, offs = rows.column("bytes").to_pylist(), off.tolist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    least, most = np.full(len(texts), length), np.full(len(texts), -1)  # distances before the anchor at which such windows begin
    for near, far in zip(edge, edge[1:], strict=False):
        at = np.flatnonzero((near <= off) & (off + length - (far - 1) <= size)) if near < far else np.zeros(0, np.int64)
        own = np.array([xxh3_64_intdigest(texts[i][offs[i] - near : offs[i] + length - (far - 1)]) for i in at.tolist()], np.uint64)
        order = np.lexsort((own, anchor[at]))
        at, own = at[order], own[order]
        same = (own[1:] == own[:-1]) & (anchor[at][1:] == anchor[at][:-1])
        hit = at[np.append(same, False) | np.append(False, same)] if len(at) else at
        least[hit], most[hit] = np.minimum(least[hit], near), np.maximum(most[hit], far - 1)
    keep = np.flatnonzero(most >= 0)
    first = np.maximum(off - most, 0)[keep]
    end = np.minimum(off - least + length, size)[keep]
    cut = pa.array([texts[i][a:b] for i, a, b in zip(keep.tolist(), first.tolist(), end.tolist(), strict=True)], pa.binary())
    kept = rows.take(pa.array(keep))
    return pa.table({"id": kept.column("id"), "row": kept.column("row"), "lo": pa.array(lo[keep] + first), "bytes": cut})


def _sorted_shards(length: int, most: int):
    """Contexts sorted by anchor -> repeated windows of each, as (id, row, lo, hi) of first and last window; a shard is whole anchors of at least SHARD_BYTES."""

    def find(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        contexts = pa.concat_arrays([pa.array([], pa.binary()), *rows.column("bytes").chunks])
        data, at = bytes_of(contexts)
        ends = np.diff(at) - length  # last window's start in each context
        count = ends + 1
        owner = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated(data, at[owner] + inside, length, most)
        doc = np.searchsorted(at, hit, "right") - 1
        off = hit - at[doc]
        new = np.append(True, (doc[1:] != doc[:-1]) | (off[1:] != off[:-1] + 1)) if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(hit) - 1) if len(hit) else first
        base = rows.column("lo").to_numpy()
        pick = pa.array(doc[first])
        return pa.RecordBatch.from_arrays(
            [rows.column("id").combine_chunks().take(pick), rows.column("row").combine_chunks().take(pick), pa.array(base[doc[first]] + off[first]), pa.array(base[doc[first]] + off[last])],
            ["id", "row", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of which the last anchor may go on
        ready: list[pa.Table] = []  # cut to what can repeat, whole anchors
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.nbytes for x in held) >= SHARD_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                anchor = rows.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    ready.append(_cut_to_repeats(rows.slice(0, cut), length))
                held = rows.slice(cut).combine_chunks().to_batches()
            if sum(x.nbytes for x in ready) >= SHARD_BYTES:
                yield find(pa.concat_tables(ready))
                ready = []
        if held:
            ready.append(_cut_to_repeats(pa.Table.from_batches(held), length))
        if ready:
            yield find(pa.concat_tables(ready))

    return run


def _dealt_again(length: int):
    """Contexts of one anchor -> parts of them by the least of another hash in each window: equal windows still share a part's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts = batch.column(3)
            data, at = bytes_of(contexts)
            text, h, place, lo, hi = anchors(data, at, length, SECOND)
            raw, base = data.tobytes(), at[text]
            pick = pa.array(text)
            key = _mix(batch.column(4).to_numpy().view(np.uint64)[text] ^ _mix(h)).view(np.int64)
            parts = pa.array([raw[a:b] for a, b in zip((base + lo).tolist(), (base + hi + length).tolist(), strict=True)], pa.binary())
            first = batch.column(2).to_numpy()[text] + lo
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(first), parts, pa.array(key), pa.array(place - lo)], ["id", "row", "lo", "bytes", "anchor", "off"])

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, many: int = MANY_CONTEXTS, queued: int = QUEUED) -> DataFrame:
    """(id, row, lo, hi): all windows of ``length`` bytes that start at lo to hi of a document occur elsewhere too."""
    if not 2 <= length <= 1 << MORE_BITS:
        raise ValueError(f"a window has 2 to {1 << MORE_BITS} bytes")
    spark = docs.sparkSession
    found = checkpointed(_several(_contexts(docs, id_col, text_col, length)))
    release(spark)
    first = F.min(F.struct("id", "row", "lo", "at")).alias("first")
    by_context = checkpointed(found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), first).select("anchor", "context", "n", "first.*"))
    several = by_context.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    low = (1 << MORE_BITS) - 1
    lo, more, off = F.col("lo"), F.shiftright("at", MORE_BITS), F.col("at").bitwiseAND(low)
    wanted = by_context.join(several, "anchor").select("id", "row", F.struct("anchor", "m", "lo", more.alias("more"), off.alias("off")).alias("w"))

    # the texts of the contexts to be sorted
    own = docs.select(column(id_col).alias("__id"), row_key(id_col, text_col).alias("__row"), column(text_col).cast("binary").alias("t"))
    wanted = wanted.groupBy("id", "row").agg(F.collect_list("w").alias("ws"))
    met = wanted.join(own, (F.col("row") == F.col("__row")) & F.col("id").eqNullSafe(F.col("__id"))).select("id", "row", "t", F.explode("ws").alias("w"))
    cut = F.substring("t", (F.col("w.lo") + 1).cast("int"), (F.col("w.more") + length).cast("int"))
    texts = checkpointed(met.select("id", "row", "w.lo", cut.alias("bytes"), "w.anchor", "w.off", "w.m"))
    release(spark)

    few, hot = texts.filter(F.col("m") <= many).drop("m"), texts.filter(F.col("m") > many).drop("m")
    dealt = few.unionByName(hot.mapInArrow(_dealt_again(length), few.schema))
    part = dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_shards(length, queued), schema_of(few, ["id"], "row long, lo long, hi long"))
    # contexts that come more than once are repeated as a whole, wherever they are
    often = by_context.filter("n > 1").select("anchor", "context")
    whole = found.join(often, ["anchor", "context"], "left_semi").select("id", "row", "lo", (lo + more).alias("hi"))
    return checkpointed(part.unionByName(whole))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), length: int = LENGTH, **options) -> DataFrame:
    """One row per document: id, ``keep``..., n_bytes, n_removed, n_spans, kept_sha256, spans (``start:end`` byte ranges removed), kept (bytes).

    Null texts are empty; texts under ``length`` bytes are never touched. Repeated rows (same id and text) repeat each other and come out alike, and
    so do equal texts under several ids: all copies of a repeated string go. An empty table gives no rows. A text of any length is one block of its
    task. Columns other than those named are ignored, whatever their names.
    """
    windows = repeated_windows(docs, id_col, text_col, length, **options)
    release(docs.sparkSession)  # of all that led to the windows only these are needed from here on
    names = [id_col, *keep]
    id_at, row_at, key_at, text_at, spans_at = free_names(docs.select(*map(column, names)), "id_", "row_", "key_", "text_", "spans_")
    held = windows.groupBy(F.col("id").alias(id_at), F.col("row").alias(row_at)).agg(F.collect_set(F.struct("lo", "hi")).alias(spans_at))
    own = docs.select(*map(column, names), row_key(id_col, text_col).alias(key_at), F.coalesce(column(text_col), F.lit("")).cast("binary").alias(text_at))
    met = own.join(held, (F.col(key_at) == F.col(row_at)) & column(id_col).eqNullSafe(F.col(id_at)), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(names)
            rows: list[list] = [[], [], [], [], [], []]
            for raw, spans in zip(batch.column(k), batch.column(k + 1), strict=True):
                data, gone = raw.as_py(), spans.as_py()
                cuts = _union(gone, length) if gone else []
                parts, at = [], 0
                for s, e in cuts:
                    parts.append(data[at:s])
                    at = e
                kept = b"".join([*parts, data[at:]])
                for col, v in zip(rows, (len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), ",".join(f"{s}:{e}" for s, e in cuts), kept), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    schema = schema_of(docs, names, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary")
    return met.select(*map(column, names), text_at, spans_at).mapInArrow(cut, schema)


def _union(spans: list[dict], length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
