"""Prefix trie of conversations by van Emde Boas recursion over their depth.

Turns are rows (conversation, depth, label); no conversation and no node is ever gathered in one task. A range of depths is cut at half:
the prefix that ends at the cut gets a name, an upper trie lies above it, and under each named cut hangs a lower forest. Both halves are cut
again in the same way, all ranges of one size in one pass, so that a trie of depth D takes log2(D) passes down and as many up:

* down (``named``): the halves' labels are folded into one label per dyadic range, and the name at each cut is the name at the range's top
  with the upper half's label. Equal prefixes get equal names, wherever they are.
* up (``grafted``): totals inside ranges of one depth are the nodes' own. Two neighbouring ranges become one when the totals of each lower
  tree are grafted on its cut and carried to the cut's ancestors in the upper range, along any one conversation that runs through it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, column

ROOT = bytes(16)
#: Turns that are numbered together, as a power of two; ids whose decimals are joined together.
TURN_BITS, ID_BLOCK = 12, 1024
NOTHING = sha256(b"").hexdigest()


def _hashed(*parts: Column) -> Column:
    """128 bits of SHA-256 of parts of fixed length."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, depth, label, size): the turns of each conversation numbered from 1 by turn (null first), then label where turns tie.

    ``label`` stands for role and text (null as empty), ``size`` is the text's UTF-8 bytes. Repeated rows are turns of their own. Rows
    without a conversation id belong to none and are left out.
    """
    said = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    own = conversations.filter(column(conv_col).isNotNull()).select(
        column(conv_col).cast("long").alias("conv"),
        column(turn_col).cast("long").alias("turn"),
        _hashed(F.octet_length(said[0]).cast("string").cast("binary"), F.lit(b":"), said[0].cast("binary"), said[1].cast("binary")).alias("label"),
        F.octet_length(said[1]).cast("long").alias("size"),
    )
    own = own.withColumn("block", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62)))).select("conv", "block", "turn", "label", "size")
    # a long conversation is numbered block by block
    per = own.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("conv", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "label"))
    placed = own.withColumn("inside", inside).join(per, ["conv", "block"])
    return placed.select("conv", (F.col("before") + F.col("inside")).cast("long").alias("depth"), "label", "size")


def branched(turns: DataFrame, base: Column, take: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that begin with the first turns of another one: (conv, depth, label, size), (conv, n).

    Every conversation of ``turns`` gets the first ``take`` (at most ``most``) turns of conversation ``base`` (all if it has fewer, none if there
    is none), then its own after its first ``take``. Both are columns over ``conv``.
    """
    sizes = turns.groupBy("conv").agg(F.max("depth").alias("n")).withColumns({"base": base, "take": take})
    heads = turns.filter(F.col("depth") <= most).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("depth", "label", "size"))).alias("head"))
    plan = sizes.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("take").cast("int"))).otherwise(F.array()))
    plan = checkpointed(plan.select("conv", "n", "take", "head", F.size("head").cast("long").alias("got")))
    taken = plan.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    own = turns.join(plan.select("conv", "take", "got"), "conv").filter(F.col("depth") > F.col("take"))
    kept = own.select("conv", (F.col("depth") - F.col("take") + F.col("got")).alias("depth"), "label", "size")
    return taken.unionByName(kept), plan.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("take"), F.lit(0))).alias("n"))


def named(turns: DataFrame, longest: int) -> DataFrame:
    """(conv, depth, size, name) of ``turns`` (conv, depth, label, size), of ``longest`` turns at most: equal prefixes have equal names.

    A range of 2^(k+1) depths is cut after 2^k. First the labels of ever larger upper halves are folded; then, from the largest range on, the
    cut and all that lies in its lower half take the range's top on, folded with the upper half's label.
    """
    halves = [turns.select("conv", "depth", _hashed(F.lit(b"\x00"), "label").alias("half"))]
    for k in range(1, longest.bit_length()):
        pair = halves[-1].groupBy("conv", F.shiftright(F.col("depth") + ((1 << k) - 1), k).alias("j"))
        pair = pair.agg(F.count(F.lit(1)).alias("n"), F.min_by("half", "depth").alias("first"), F.max_by("half", "depth").alias("then"))
        halves.append(checkpointed(pair.filter("n = 2").select("conv", F.shiftleft("j", k).alias("depth"), _hashed(F.lit(bytes([k])), "first", "then").alias("half"))))
    turns = turns.select("conv", "depth", "size", F.lit(ROOT).alias("name"), _hashed(F.lit(b"\x00"), "label").alias("own"))
    state = None
    for k in reversed(range(len(halves))):
        # turns down to 2^k take part from here on: all above the cut lie in the upper half of every range so far
        fresh = turns.filter(F.col("depth").between(1 << k, (2 << k) - 1))
        state = fresh if state is None else state.unionByName(fresh)
        low, half = F.shiftright("depth", k).bitwiseAND(1) == 1, F.col("own")
        if k:
            cuts = halves[k].withColumn("cut", F.shiftright("depth", k)).filter(F.col("cut") % 2 == 1).select("conv", "cut", "half")
            state, half = state.withColumn("cut", F.shiftright("depth", k)).join(cuts, ["conv", "cut"], "left").drop("cut"), F.col("half")
        state = state.select("conv", "depth", "size", F.when(low, _hashed(F.lit(bytes([k])), "name", half)).otherwise(F.col("name")).alias("name"), "own")
    return (turns if state is None else state).drop("own")


def grafted(rows: DataFrame, nodes: DataFrame, longest: int, *sums: str) -> DataFrame:
    """(name, sums) over each node's subtree, itself included, of ``nodes`` (name, above, conv, depth, sums) below the root; ``rows`` (conv, depth,
    name, above) holds the path of every conversation, ``conv`` of a node is any one that runs through it.

    Ranges grow from one depth on; a pass makes pairs of ranges of 2^k depths one. The tops of the lower ranges are added up by the cut above
    them, and each cut's sum goes to the cut and its ancestors in the upper range, which stand on the conversation's path.
    """
    added = [F.sum(c).alias(c) for c in sums]
    parts = [nodes.select("name", "above", "conv", "depth", *sums)]
    for k in range((longest - 1).bit_length()):
        tops = None
        for part in parts:  # a node's total so far is its own and what earlier passes have brought
            own = part.filter((F.col("depth") - 1).bitwiseAND((1 << (k + 1)) - 1) == 1 << k)
            tops = own if tops is None else tops.unionByName(own)
        cuts = tops.groupBy("above", "depth").agg(F.min("conv").alias("conv"), *added)
        path = cuts.select("conv", F.explode(F.sequence(F.col("depth") - (1 << k), F.col("depth") - 1)).alias("depth"), *sums)
        met = path.join(rows.select("conv", "depth", "name", "above"), ["conv", "depth"])
        parts.append(checkpointed(met.groupBy("name", "above", "depth").agg(F.min("conv").alias("conv"), *added)))
    whole = None
    for part in parts:
        whole = part.select("name", *sums) if whole is None else whole.unionByName(part.select("name", *sums))
    return whole.groupBy("name").agg(*added)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the decimal ids of all conversations that end at a node, ascending, joined by commas. Neighbouring ids are
    joined first; what is left of a node streams through one hash, so that it is never held."""
    bounded_batches(ends.sparkSession)
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = ends.groupBy("name", F.floor(F.col("conv") / ID_BLOCK).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    pieces = pieces.repartition("name").sortWithinPartitions("name", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name == last:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = name, sha256(ids.encode())
            yield out(done)
        if state is not None:
            yield out([(last, state.hexdigest())])

    def out(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])

    return pieces.mapInArrow(run, "name binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the prefix trie of ``turns`` (conv, depth, label, size), of conversations of ``lengths`` (conv, n turns).

    nodes: name, conv (the smallest member), depth, parent_conv (null at the root), n_convs, n_children, n_leaves and saved (bytes of last texts
    that members share, once less than members; both over the subtree). ends: name, conv. A conversation without turns ends at the root; no
    conversations give no rows; equal conversations are members of the same nodes. (conv, depth) tells a node as well as its name.
    """
    all_of = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("n").alias("longest")).first()
    longest, spark = all_of["longest"] or 0, turns.sparkSession
    rows = named(turns, longest)
    rows = checkpointed(rows)
    before = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("above"))
    rows = checkpointed(rows.join(before, ["conv", "depth"], "left").withColumn("above", F.coalesce("above", F.lit(ROOT))))
    nodes = rows.groupBy("name", "above", "depth").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"))
    nodes = checkpointed(nodes)
    children = nodes.groupBy(F.col("above").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    top = spark.range(1 if all_of["n"] else 0).select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("depth"), F.lit(all_of["conv"]).cast("long").alias("conv"), F.lit(all_of["n"]).alias("n_convs"), F.lit(0).cast("long").alias("size"))
    nodes = nodes.unionByName(top).join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    nodes = checkpointed(nodes)
    totals = checkpointed(grafted(rows, nodes.filter("depth > 0"), longest, "n_leaves", "saved"))
    # the root's total: its own and those of the nodes of depth 1
    tops = nodes.filter("depth = 1").join(totals, "name", "left_semi").select("name").join(totals, "name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")).first()
    whole = totals.unionByName(nodes.filter("depth = 0").select("name", (F.col("n_leaves") + F.lit(tops["n_leaves"] or 0)).alias("n_leaves"), F.lit(tops["saved"] or 0).cast("long").alias("saved")))
    parents = nodes.filter("depth > 0").select(F.col("name").alias("above"), F.col("conv").alias("parent"))
    found = nodes.drop("n_leaves", "saved", "size").join(whole, "name")
    deep = found.filter("depth > 1").join(parents, "above").select(*found.columns, F.col("parent").alias("parent_conv"))
    # the parent of a third of all nodes may be the root, which is known
    flat = found.filter("depth <= 1").withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(all_of["conv"])).cast("long"))
    last = rows.join(lengths.select("conv", F.col("n").alias("depth")), ["conv", "depth"], "left_semi").select("name", "conv")
    ends = last.unionByName(lengths.filter("n = 0").select(F.lit(ROOT).alias("name"), "conv"))
    return deep.unionByName(flat).drop("above"), ends


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """trie() of conversations as they are: null roles and texts are empty, turns are in the order of ordered(); other columns are ignored."""
    turns = checkpointed(ordered(conversations, conv_col, turn_col, role_col, text_col))
    return trie(turns, turns.groupBy("conv").agg(F.max("depth").alias("n")))


def branched_trie(conversations: DataFrame, base: Column, take: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """trie() of branched() conversations."""
    turns, lengths = branched(checkpointed(ordered(conversations)), base, take, most)
    return trie(checkpointed(turns), checkpointed(lengths))
