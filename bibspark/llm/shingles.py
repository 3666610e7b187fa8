"""Near-duplicate documents by the exact Jaccard similarity of their sets of 5-word shingles.

Candidates are found without loss: in any order of all shingles, two sets of similarity SIMILAR or more share one of the first
n - ceil(SIMILAR * n) + 1 shingles of each. Documents that share such a shingle meet in its cell. The order is by hash, but for frequent
shingles, which come last: passages that many documents have fill no cell, unless four fifths of a document are such passages. Which
shingles count as frequent decides on the cost alone, never on the result, so their number is bounded (MOST_HOT) and they are broadcast.

In a cell, documents are sieved by size and by the SimHash of their shingles - the Manhattan distance of the fingerprints' segment counts,
a lower bound, then the differing bits (at SIMILAR, 64-bit fingerprints differ in about 10 bits with a deviation of 3, so MOST_BITS is far
out) - and then verified by their texts. Cells of up to SMALL documents hand on all pairs, larger ones a spanning forest first and, once
its edges are verified, the pairs of documents that are not in one component yet: large groups of copies cost few pairs. Cells over CHUNK
are split into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, filled, release, row_key, schema_of
from .graph import components
from .lines import Lines, _mix, _WordHash, words_of
from .segments import manhattan, segment_counts

SHINGLE, MOST_BITS = 5, 24
#: Similarity as a fraction, so that it is compared in integers.
NUM, DEN = 4, 5
SMALL, CHUNK, CHUNK_SHINGLES = 8, 4096, 1 << 21
#: Distinct sets that share a cell from which on its shingle is frequent; frequent shingles that are told apart (8 MB).
HOT, MOST_HOT = 32, 1 << 20
#: Rows (of three numbers) up to which the names of wanted texts are broadcast; more meet the texts in a shuffle.
MOST_SENT = 1 << 18


def shingle_sets(texts: list[str], cache: _WordHash) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, a wordless one has none."""
    own = Lines([words_of(x) for x in texts], cache)
    out = []
    for a, n in zip(own.start.tolist(), own.n.tolist(), strict=True):
        at = a + np.arange(max(n - SHINGLE + 1, min(n, 1)))
        out.append(np.unique(_mix(own.range(at, np.minimum(at + SHINGLE, a + n)) ^ np.uint64(min(n, SHINGLE)))))
    return out


class _SetsByText:
    """Shingle sets by the number of the text. Those of the last texts are held, CHUNK_SHINGLES hashes and one set at most."""

    def __init__(self):
        self.cache, self.held, self.size = _WordHash(), {}, 0

    def of(self, s: int, text: pa.StringScalar) -> np.ndarray:
        if s not in self.held:
            if self.size > CHUNK_SHINGLES:
                self.held, self.size = {}, 0
            self.held[s] = shingle_sets([text.as_py() or ""], self.cache)[0]
            self.size += len(self.held[s])
        return self.held[s]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _among(u: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``u`` are in the sorted array ``known``."""
    return known[np.minimum(np.searchsorted(known, u), len(known) - 1)] == u if len(known) else np.zeros(len(u), bool)


def _prefix(u: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, one of which any similar set has among its own: frequent ones come last."""
    size = len(u) - -(-NUM * len(u) // DEN) + 1
    late = _among(u, hot)
    return np.concatenate([u[~late][:size], u[late]])[:size]


def _sketches(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, row, s, n, fp, prefix): hash and size of each document's shingle set, its SimHash and its first shingles."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        cache = _WordHash()
        for batch in batches:
            s, n, fp, prefix = [], [], [], []
            for text in filled(batch.column(2)):
                u = shingle_sets([text.as_py()], cache)[0]
                ones = np.zeros(64, np.int64)
                for k in range(0, len(u), 1 << 16):
                    ones += np.unpackbits(u[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                s.append(xxh3_64_intdigest(u.tobytes()) if len(u) else 0)
                n.append(len(u))
                fp.append(int.from_bytes(np.packbits(2 * ones > len(u)).tobytes(), "big"))
                prefix.append(_prefix(u, shared.value) if len(u) else u)
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            cells = pa.array(np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(s), long(n), long(fp), pa.ListArray.from_arrays(pa.array(ends), cells)], ["doc_id", "row", "s", "n", "fp", "prefix"])

    found = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    return found.mapInArrow(run, schema_of(docs, ["doc_id"], "row long, s long, n long, fp long, prefix array<long>"))


def _counted(docs: DataFrame, of) -> DataFrame:
    """(cell, n): how many texts have each of the shingles that ``of`` picks from their sets, added up in each task first."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = _WordHash(), [], 0

        def counted() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

        for batch in batches:
            for text in filled(batch.column(0)):
                held.append(of(shingle_sets([text.as_py()], cache)[0]))
                size += len(held[-1])
                if size >= 1 << 20:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _frequent(docs: DataFrame, hot: int) -> np.ndarray:
    """Sorted shingles that ``hot`` or more documents share, among the documents with such a one in their prefix by hash; the MOST_HOT most frequent ones."""

    def most(counts: DataFrame) -> np.ndarray:
        rows = counts.filter(F.col("n") >= hot).orderBy(F.desc("n"), "cell").limit(MOST_HOT).select("cell").toPandas()
        return np.sort(rows["cell"].to_numpy(np.int64).view(np.uint64))

    none = np.zeros(0, np.uint64)
    seeds = most(_counted(docs, lambda u: _prefix(u, none) if len(u) else u))
    if not len(seeds):
        return seeds
    shared = docs.sparkSession.sparkContext.broadcast(seeds)  # at most MOST_HOT numbers
    return most(_counted(docs, lambda u: u if len(u) and _among(_prefix(u, none), shared.value).any() else none))


def _shared(nodes: DataFrame) -> DataFrame:
    """(s, cell, n, fp) of cells that more than one shingle set shares; equal cells pass by in order, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, which may meet its equal in the next batch
        sent = False  # whether it has gone out already
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cell = own.column(0).to_numpy()
            same = cell[1:] == cell[:-1]
            keep = np.append(False, same) | np.append(same, False)
            last = bool(keep[-1])
            if sent:
                keep[0] = False
            yield own.filter(pa.array(keep))
            held, sent = own.slice(own.num_rows - 1), last

    cells = nodes.select(F.explode("prefix").alias("cell"), "s")
    shared = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, s long")
    return shared.join(nodes.select("s", "n", "fp"), "s")


def _sieved(i: int, j: np.ndarray, n: np.ndarray, fp: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of the places ``j`` that can be similar to place ``i``."""
    j = j[DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])]
    j = j[manhattan(counts[i], counts[j]) <= MOST_BITS]
    return j[np.bitwise_count(fp[i] ^ fp[j]) <= MOST_BITS]


def _cell_pairs(n: np.ndarray, fp: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) in one cell that pass the sieve: all, or in a cell of over ``small`` rows edges that connect them, towards the least place."""
    size, parent, counts, left, right = len(n), np.arange(len(n)), segment_counts(fp), [], []
    for i in range(size - 1):
        j = np.arange(i + 1, size)
        if size > small:
            j = j[parent[j] != parent[i]]
        j = _sieved(i, j, n, fp, counts)
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j)
            if size > small:
                parent[np.isin(parent, parent[j])] = parent[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _cell_links(n: np.ndarray, fp: np.ndarray, root: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) in one cell that are similar and connect different components. ``sets`` are the shingle sets end to end."""
    starts, counts = np.cumsum(n) - n, segment_counts(fp)
    parent, left, right = np.unique(root, return_inverse=True)[1], [], []
    token = np.unique(sets, return_inverse=True)[1]
    own = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = _sieved(i, j[parent[j] != parent[i]], n, fp, counts)
        if not len(j):
            continue
        mine = token[starts[i] : starts[i] + n[i]]
        own[mine] = True
        shared = np.add.reduceat(own[token[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])[j - i - 1]
        own[mine] = False
        j = j[DEN * shared >= NUM * (n[i] + n[j] - shared)]
        if len(j):
            j = j[np.unique(parent[j], return_index=True)[1]]
            left.append(np.full(len(j), i))
            right.append(j)
            parent[np.isin(parent, parent[j])] = parent[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _routed(cells: DataFrame, cols: list[str], chunk: int) -> DataFrame:
    """The rows sorted by cell, each large cell as the cells of all pairs of its chunks."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    large = cells.groupBy("cell").agg(parts.alias("parts")).filter("parts > 1")
    own, other = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"), F.col("other")
    routed = (
        cells.join(large, "cell", "left")
        .select("cell", *cols, F.coalesce("parts", F.lit(1)).alias("parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least(own, other), F.greatest(own, other))).alias("cell"), *cols)
    )
    return routed.repartition("cell").sortWithinPartitions("cell", "s")


def _whole_cells(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """Batches sorted by cell -> tables of whole cells of some size."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            rows = pa.Table.from_batches(held).combine_chunks()
            cell = rows.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cells_of(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """(start, end) of each cell of several rows."""
    cell = rows.column(0).to_numpy()
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist()
    yield from ((a, b) for a, b in zip(at, [*at[1:], len(cell)], strict=True) if b - a > 1)


def _by_cell(pairs_of):
    """Batches sorted by cell -> (a, b) of the place pairs that ``pairs_of`` gives for the rows of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            s, found = rows.column(1).to_numpy(), [np.zeros((0, 2), np.int64)]
            for a, b in _cells_of(rows):
                i, j = pairs_of(rows.slice(a, b - a))
                found.append(np.stack([s[a:b][i], s[a:b][j]], axis=1))
            both = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    return run


def _of_cells(rows_of):
    """Batches sorted by cell -> the rows of each cell that ``rows_of`` marks. The cell is named anew by who they are, so that cells of the same rows
    become one; cells that should meet in one name by chance only compare more."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            keep, cell, s = np.zeros(rows.num_rows, bool), np.zeros(rows.num_rows, np.uint64), rows.column(1).to_numpy()
            for a, b in _cells_of(rows):
                keep[a:b] = rows_of(rows.slice(a, b - a))
                cell[a:b] = xxh3_64_intdigest(s[a:b][keep[a:b]].tobytes())
            yield from rows.set_column(0, "cell", pa.array(cell.view(np.int64))).filter(pa.array(keep)).to_batches()

    return run


def _fingerprints(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("n").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)


def candidates(cells: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """(a, b): pairs of shingle sets that share a cell and pass the sieve, of large cells those of a forest."""
    run = _by_cell(lambda rows: _cell_pairs(*_fingerprints(rows), small))
    return _routed(cells, ["s", "n", "fp"], chunk).mapInArrow(run, "a long, b long").distinct()


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(s, text) of the shingle sets in ``wanted`` (s)."""
    named = checkpointed(wanted.join(nodes.select("s", "first"), "s").select("s", F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__row")))
    if named.count() <= MOST_SENT:
        named = F.broadcast(named)
    own = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    return own.join(named, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("s", "text").dropDuplicates(["s"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose texts are similar."""
    texts = checkpointed(_texts(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), nodes, docs))
    both = pairs.join(texts.select(F.col("s").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("s").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for batch in batches:
            good = [similar(*shingle_sets([x.as_py() or "", y.as_py() or ""], cache)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _settled(cells: DataFrame, nodes: DataFrame, docs: DataFrame, small: int, chunk: int) -> DataFrame:
    """(a, b): similar pairs that link components within large cells; ``cells`` has the component of each row as root. Only rows that pass the sieve with
    a row of another component get their sets."""
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter((F.col("m") > small) & (F.col("r0") != F.col("r1")))
    some = cells.join(large.select("cell"), "cell", "left_semi")

    def sieved(rows: pa.Table) -> np.ndarray:
        (n, fp), root = _fingerprints(rows), rows.column("root").to_numpy()
        keep, counts = np.zeros(len(n), bool), segment_counts(fp)
        for i in range(len(n) - 1 if (root != root[0]).any() else 0):
            j = np.arange(i + 1, len(n))
            j = _sieved(i, j[root[j] != root[i]], n, fp, counts)
            keep[i] |= len(j) > 0
            keep[j] = True
        return keep

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _SetsByText()

        def of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            own = [known.of(s, text) for s, text in zip(rows.column("s").to_pylist(), rows.column("text"), strict=True)]
            return _cell_links(*_fingerprints(rows), rows.column("root").to_numpy(), np.concatenate(own))

        yield from _by_cell(of)(batches)

    cols = ["s", "n", "fp", "root"]
    routed = _routed(some, cols, chunk)
    some = checkpointed(routed.mapInArrow(_of_cells(sieved), routed.schema).distinct())
    texts = checkpointed(_texts(some.select("s").distinct(), nodes, docs))
    # texts, not sets: hashes are larger and do not compress
    met = some.join(texts, "s").select("cell", *cols, "text").repartition("cell").sortWithinPartitions("cell", "s")
    return met.mapInArrow(links, "a long, b long").distinct()


def groups(docs: DataFrame, small: int = SMALL, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(doc_id, row) of the first document of each component of similar documents: least id (null ids last), then least row hash.

    Wordless documents are one component. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")

    frequent = _frequent(docs, hot)
    release(spark)
    nodes = checkpointed(_sketches(docs, frequent).groupBy("s").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")))
    release(spark)
    cells = checkpointed(_shared(nodes))
    release(spark)
    good = checkpointed(_verified(checkpointed(candidates(cells, small, chunk)), nodes, docs))
    roots = components(good).withColumnsRenamed({"node": "s", "component": "root"})
    apart = checkpointed(cells.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")))
    release(spark)
    more = checkpointed(_settled(apart, nodes, docs, small, chunk))
    release(spark)
    found = components(good.unionByName(more))
    named = nodes.select("s", "first").join(found, F.col("s") == F.col("node"), "left").select("first", F.coalesce("component", "s").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("b"))
    return best.select("b.doc_id", "b.row")
