"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance
of two embeddings never exceeds the fingerprints' Hamming distance, so pairs within 3 bits lie
within Manhattan distance 3. Grid: the segments are dealt into GROUPS groups; a pair within 3 agrees
on all but 3 groups at most, hence it shares a cell of at least one of the C(GROUPS, 3) grids that
leave 3 groups out. Inside a cell fingerprints are ordered by their total bit count, compared only
within a range of 3 of it, sieved by the Manhattan distance and verified exactly. A cell hands on a
spanning forest, not its pairs; oversized cells are split into pairs of chunks, so that tasks stay
bounded however many fingerprints meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import bounded_batches, checkpointed, column, filled, free_names, row_key, schema_of
from .graph import components
from .segments import _FIELDS, manhattan, segment_counts

SHINGLE, SEED, MOST_BITS = 3, 42, 3
GROUPS = 6
#: Fingerprints of one chunk of an oversized cell.
CHUNK = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes) -> int:
    """Majority of the XXH64 bits of all 3-word shingles; signed 64-bit pattern."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return int.from_bytes(digest(joined, SEED), "big", signed=True)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = len(words) - SHINGLE + 1
    starts, stops = (ends - sizes)[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 15)], stops[k : k + (1 << 15)], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``..., fp long) of whole texts; null and wordless texts have fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(batch.num_columns - 1)).cast(pa.large_binary())
            own = pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], names)

    names = [id_col, *keep, "fp"]
    return docs.select(*map(column, names[:-1]), column(text_col)).mapInArrow(run, schema_of(docs, names[:-1], "fp long"))


# ---------------------------------------------------------------- grid
def grid_masks(groups: int = GROUPS) -> list[int]:
    """One mask of embedding fields per grid: all groups but MOST_BITS of them."""
    edge = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << 2 * f for f in range(edge[g], edge[g + 1])) for g in range(groups)]
    return [sum(masks[g] for g in chosen) for chosen in combinations(range(groups), groups - MOST_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_cells(nodes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(cell, fp): the fingerprint's cell in every grid. Native."""
    high, fields = F.shiftrightunsigned("fp", 1), F.lit(_FIELDS)
    counts = F.shiftleft(high.bitwiseAND(F.col("fp")).bitwiseAND(fields), 1).bitwiseOR(high.bitwiseXOR(F.col("fp")).bitwiseAND(fields))
    cells = F.array(*(F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(grid_masks(groups))))
    return nodes.select("fp", counts.alias("e")).select("fp", F.explode(cells).alias("cell"))


def _forest(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (cell, bit count): edges (row, least linked row) that connect all rows of a cell within MOST_BITS."""
    n, parent = len(fp), np.arange(len(fp))
    weight, counts = np.bitwise_count(fp).astype(np.int16), segment_counts(fp)
    rows, lag = np.arange(n), 1
    while True:
        rows = rows[rows + lag < n]
        near = (cell[rows] == cell[rows + lag]) & (weight[rows + lag] - weight[rows] <= MOST_BITS)
        rows = rows[near]  # sorted: a row out of range at this lag stays out of range
        if not len(rows):
            break
        i = rows[parent[rows] != parent[rows + lag]]
        i = i[manhattan(counts[i], counts[i + lag]) <= MOST_BITS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= MOST_BITS]
        j = i + lag
        while len(i):
            a, b = parent[i], parent[j]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            apart = parent[i] != parent[j]
            i, j = i[apart], j[apart]
        lag += 1
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def links(nodes: DataFrame, groups: int = GROUPS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges whose connected components are those of 'at most 3 differing bits'. ``nodes`` has distinct fp and is cheap to read again."""
    cells = grid_cells(nodes, groups)
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / chunk).cast("int")
    own, other = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.col("other")
    routed = (
        cells.join(large, "cell", "left")
        .select("cell", "fp", parts.alias("parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least(own, other), F.greatest(own, other))).alias("cell"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            cell, fp = rows[0], rows[1].view(np.uint64)
            same = cell[1:] == cell[:-1]
            keep = np.append(False, same) | np.append(same, False)
            cell, fp = cell[keep], fp[keep]
            order = np.lexsort((np.bitwise_count(fp), cell))
            cell, fp = cell[order], fp[order]
            i, j = _forest(cell, fp)
            pairs = np.unique(np.stack([fp[i].view(np.int64), fp[j].view(np.int64)], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if not rows.shape[1]:
                continue
            held.append(rows)
            if sum(r.shape[1] for r in held) >= 1 << 18:
                rows = np.concatenate(held, axis=1)
                cut = np.searchsorted(rows[0], rows[0, -1])  # the last cell may go on in the next batch
                if cut:
                    yield flush(rows[:, :cut])
                held = [rows[:, cut:]]
        if held:
            yield flush(np.concatenate(held, axis=1))

    return routed.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), groups: int = GROUPS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, ``keep``..., fingerprint (16 hex digits), component_id (least id reachable by links of at most 3 bits), root (a number of the component).

    Wordless documents (null, empty) have fingerprint zero and link like any other. Repeated rows share a component, and ties (equal fingerprints
    or ids) do too. A null id never names a component that has another id. An empty table gives no rows. Texts of any length are hashed whole, in
    slices. Columns other than those named are ignored, whatever their names.
    """
    own = checkpointed(fingerprints(docs, id_col, text_col, keep))
    nodes = checkpointed(own.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    found = components(links(nodes, groups, chunk))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(roots, "root").select(F.col("fp").alias("__fp"), "component_id", "root")
    out = own.join(by_fp, F.col("fp") == F.col("__fp"))
    return out.select(id_col, *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (all columns) per component of similar documents (see shingles): that of the least id (null ids last), of several the one with
    the least row hash; repeated rows stay once. Wordless texts, null or empty, are one component. An empty table gives no rows."""
    own, best = free_names(docs, "own", "best")
    # one key for the join and for repeated rows, of one type on both sides: texts move once
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row", T.LongType())])
    name = lambda doc_id, row: F.struct(doc_id, row).cast(kind)
    named = docs.withColumn(own, name("doc_id", row_key("doc_id", "text")))
    kept = named.join(shingles.groups(docs).select(name("doc_id", F.col("row")).alias(best)), F.col(own) == F.col(best), "left_semi")
    return kept.dropDuplicates([own]).drop(own)
