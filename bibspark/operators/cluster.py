"""Order-dependent grouping by sorted sweeps: greedy acceptance inside buckets, and the lexicographically first star cover.

What an order-dependent pass needs is dealt out once by bucket (or component), sorted, and streamed past a small state, so that
a chain of any length is one job. Books that the matching rules cannot tell apart are one node: a node's members that come in a row
are thinned to one before they are dealt out, and rules between nodes are arcs, not pairs of books.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places of the catalogue in which a row of books of one node is thinned, as a power of two.
RUN_BITS = 12


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="bibspark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many parts as the cluster can work on, for steps that cost far more than their rows' bytes say (adaptive execution would join small parts)."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


# ---------------------------------------------------------------- greedy acceptance
ARC, EDGE, BOOK = 0, 1, 2


class _Sweep:
    """Acceptance in one bucket, row by row: arcs first, then books in order, each after its edges."""

    def __init__(self) -> None:
        self.arcs: dict[str, list[str]] = {}
        self.accepted: set[str] = set()
        self.reached: set[str] = set()
        self.sources: set[int] = set()  # accepted books from which edges go out
        self.hit, self.begun = None, False

    def meet(self, kind: int, place: int, x: str | None, y: str | None, other: int | None) -> Iterator[tuple[str | None, int]]:
        """Yields (node, place after which all of its books are accepted), or (None, place) of a single accepted book."""
        if kind == ARC:
            self.arcs.setdefault(x, []).append(y)
        elif kind == EDGE:
            if other in self.sources:
                self.hit = place
        else:
            if not self.begun or self.hit == place and x not in self.reached:
                yield None, place
            elif x not in self.reached:
                return
            self.begun = True
            if other:
                self.sources.add(place)
            if x not in self.accepted:
                self.accepted.add(x)
                for node in self.arcs.get(x, ()):
                    if node not in self.reached:
                        self.reached.add(node)
                        yield node, place


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, _Sweep()
    for batch in batches:
        out: list[tuple[str, str | None, int]] = []
        for bucket, place, kind, x, y, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last:
                last, state = bucket, _Sweep()
            out += ((bucket, node, at) for node, at in state.meet(kind, place, x, y, other))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["bucket", "node", "place"])


def accepted(members: DataFrame, arcs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Rows of ``members`` (bucket, ord, node) that a greedy pass accepts: the first of each bucket, and every one that an accepted earlier one matches.

    ``arcs`` (bucket, src, dst): any book of node src matches any later one of dst. ``edges`` (bucket, j, i): book j matches the later book i.
    One shuffle of arcs, edges and thinned members by bucket; the state of a task is one bucket's arcs. No members give no rows.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = arcs.select("bucket", F.lit(-1).cast("long").alias("place"), F.lit(ARC).alias("kind"), F.col("src").alias("x"), F.col("dst").alias("y"), none("long").alias("other"))
    if edges is None:
        listed = members.withColumns({"source": F.lit(0).cast("long"), "kept": F.lit(False)})
    else:
        ends = edges.select("bucket", F.col("j").alias("ord"), F.lit(1).alias("s")).unionByName(edges.select("bucket", F.col("i").alias("ord"), F.lit(0).alias("s"))).groupBy("bucket", "ord").agg(F.max("s").alias("s"))
        listed = members.join(ends, ["bucket", "ord"], "left").withColumns({"source": F.coalesce("s", F.lit(0)).cast("long"), "kept": F.col("s").isNotNull()})
        rows = rows.unionByName(edges.select("bucket", F.col("i").alias("place"), F.lit(EDGE).alias("kind"), none("string").alias("x"), none("string").alias("y"), F.col("j").alias("other")))
    run = Window.partitionBy("bucket", F.shiftright("ord", RUN_BITS)).orderBy("ord")
    thin = listed.withColumn("before", F.lag("node").over(run)).filter(F.col("kept") | ~F.col("before").eqNullSafe(F.col("node")))
    rows = rows.unionByName(thin.select("bucket", F.col("ord").alias("place"), F.lit(BOOK).alias("kind"), F.col("node").alias("x"), none("string").alias("y"), F.col("source").alias("other")))
    found = cut(rows.repartition("bucket").sortWithinPartitions("bucket", "place", "kind").mapInArrow(_swept, "bucket string, node string, place long"))
    later = members.join(found.filter("node is not null"), ["bucket", "node"]).filter(F.col("ord") > F.col("place")).select(*members.columns)
    single = members.join(found.filter("node is null").select("bucket", F.col("place").alias("ord")), ["bucket", "ord"], "left_semi").select(*members.columns)
    # a single book may stand behind the place after which its node is accepted as well
    return later.unionByName(single).dropDuplicates(["bucket", "ord"])


def reachable(members: DataFrame, edges: DataFrame) -> DataFrame:
    """accepted() of books that are nodes of their own: ``members`` (bucket, ord), ``edges`` (bucket, j, i) with j before i."""
    own = members.select("bucket", "ord", F.col("ord").cast("string").alias("node"))
    return accepted(own, edges.select("bucket", F.col("j").cast("string").alias("src"), F.col("i").cast("string").alias("dst")).limit(0), edges).select("bucket", "ord")


# ---------------------------------------------------------------- star cover
def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): the component is its least node. Rounds of large and small stars, as many as the
    logarithm of the longest path; each is checkpointed, one row of counts goes to the driver."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        met = pairs.join(least, "u")
        out = (met if small else met.filter("v > u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now, seen = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first())
        if not mark[0] or mark == seen:
            break
        seen = mark
        large = star(now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v"))), False)
        now = cut(star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), True))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, i, j) in order, each i first with null: i goes to its first neighbour that is a seed, or becomes one."""
    last, seeds, now, taken = None, set(), None, None

    def settle() -> Iterator[tuple[int, int]]:
        if now is not None:
            if taken is None:
                seeds.add(now)
            yield now, now if taken is None else taken

    for batch in batches:
        out: list[tuple[int, int]] = []
        for component, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (component, i) != (last, now):
                out += settle()
                if component != last:
                    last, seeds = component, set()
                now, taken = i, None
            if taken is None and j in seeds:
                taken = j
        yield _pairs(out)
    yield _pairs(list(settle()))


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["ord", "seed"])


def stars(edges: DataFrame) -> DataFrame:
    """(ord, seed) of a greedy star cover: in order, what no earlier seed has taken becomes a seed and takes all later matches left.

    ``edges`` is (j, i) with j before i. Each connected component is one sorted sweep, whose state is the component's seeds. Seeds are rows with
    ord = seed; no edges give no rows.
    """
    edges = cut(edges.select("j", "i").distinct())
    of = components(edges.select(F.col("j").alias("a"), F.col("i").alias("b"))).withColumnRenamed("node", "i")
    rows = of.select("component", "i", F.lit(None).cast("long").alias("j")).unionByName(edges.join(of, "i").select("component", "i", "j"))
    return cut(rows.repartition("component").sortWithinPartitions("component", "i", F.col("j").asc_nulls_first()).mapInArrow(_covered, "ord long, seed long"))
