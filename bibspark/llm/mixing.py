"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Every source's target is its weighted share of all words, stopped at MOST times its
size (water-filling of the excess). A keyed hash permutes a source's documents and deals them into
BLOCKS blocks; a target is whole passes over all blocks, one partial pass over the first blocks of
the permutation, and from there on every document in order that still fits what is left, until none
does. The blocks drawn are the source's exact quota.
The tree then splits the output shards again and again: at each node the left half's blocks per
source are drawn from the multivariate hypergeometric distribution, so that every shard gets the
same number of blocks, every source's quota is met exactly, and every assignment is equally likely.
A leaf takes the next disjoint run of each source's permuted draws and shuffles it locally. Nodes are
rows; WIDTH leaves of a level are split in one task, and the levels grow with the shards.

Documents meet the plan in one join on (source, block), and places in a source's permutation are
counted slice by slice: no source, however large, is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, column, count_words, packed, row_key, unpacked

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 20240607
#: Least numbers of blocks and of output shards; words of the corpus per block of a source, and per shard.
BLOCKS, SHARDS, BLOCK_WORDS, SHARD_WORDS = 1024, 64, 1_000_000, 8_000_000
#: Children of a node that one task splits off.
WIDTH = 64
#: Blocks behind a partial pass that are looked through first for documents that fit what is left, and by how many times more the next time.
FILL_BLOCKS, FILL_GROWTH = 64, 4
#: Slices of a permutation in which places are counted; a power of two.
SLICES = 1024


def _key(source: str) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def with_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` plus __source, __size (words) and __h (place in the source's permutation). Narrow; repeated rows have one place."""
    h = F.xxhash64(F.lit(seed), row_key(id_col, text_col))
    return docs.withColumns({"__source": _key(source_col), "__size": count_words(F.col(text_col)), "__h": h})


def block_of(blocks: int, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__h")), F.lit(blocks)).cast("int")


def scale(placed: DataFrame) -> tuple[int, int]:
    """(blocks per source, output shards): they grow with the corpus, so that blocks and shards do not."""
    words = placed.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    return max(BLOCKS, 1 << (words // BLOCK_WORDS).bit_length()), max(SHARDS, -(-words // SHARD_WORDS))


def targets(by_block: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(__source, source_size, weight, target) from sizes by block; one row per source."""
    sized = by_block.groupBy("__source").agg(F.sum("size").alias("source_size"))
    # '' is the null source and comes last; '=' before the name keeps the order of the names
    rank = F.row_number().over(Window.orderBy((F.col("__source") == "").cast("int"), "__source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sized.select("*", rank.alias("rank"), weight.alias("weight"), cap.alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.select("*", level.alias("level"))
    # the level of the first source, by cap per weight, that stays at or under its cap
    held = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(held["level"] * F.col("weight"), F.col("cap")))
    return filled.select("__source", "source_size", "weight", target.alias("target"))


def along(rows: DataFrame, h: Column, ties: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``rows`` plus ``name``: the sum of ``value`` over the rows of the same __source that come before in the order of the hash ``h``, then ``ties``.

    The order is cut into SLICES by the hash's leading bits: sums per slice, then places inside each, so that a large source is many groups.
    """
    cut = rows.withColumns({"__h0": h, "__v": value}).withColumn("__slice", F.shiftright("__h0", 64 - SLICES.bit_length() + 1))
    before = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("__source", "__slice").agg(F.sum("__v").alias("__v")).select("__source", "__slice", F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__source", "__slice").orderBy("__h0", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(sums, ["__source", "__slice"]).withColumn(name, F.col("__base") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__h0", "__v", "__slice", "__base")


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws from good and bad ones without replacement are good. From 1e9 on, where the generator refuses, by the inverse of the
    distribution function, added up from the ratios of neighbouring probabilities over 12 deviations around the mode."""
    if good + bad < 1_000_000_000 or not good or not bad or not sample:
        return int(draw.hypergeometric(good, bad, sample)) if good and sample else 0
    if sample == good + bad:
        return good
    n = good + bad
    share = good / n
    mode = (sample + 1) * (good + 1) // (n + 2)
    reach = int(12 * np.sqrt(sample * share * (1 - share) * (n - sample) / (n - 1))) + 12
    lo, hi = max(mode - reach, sample - bad, 0), min(mode + reach, good, sample)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    chance = np.concatenate([[0.0], np.cumsum(ratio)])
    below = np.cumsum(np.exp(chance - chance.max()))
    return lo + int(np.searchsorted(below, draw.random() * below[-1]))


def split_tree(quotas: np.ndarray, lo: int, hi: int, shards: int, total: int, seed: int, leaf: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(first shard, end, block counts) of the nodes with at most ``leaf`` shards below the node of shards lo to hi with the given counts.

    Of ``total`` blocks every shard gets its even share, to within one; each split is drawn from the multivariate hypergeometric distribution,
    by a generator that is keyed by the node. So a subtree gives the same wherever it is split.
    """
    if hi - lo <= leaf:
        return [(lo, hi, quotas)]
    mid = (lo + hi) // 2
    draw = np.random.Generator(np.random.Philox(key=[seed, lo << 32 | hi]))
    left, need, rest = np.zeros_like(quotas), total * mid // shards - total * lo // shards, int(quotas.sum())
    for i, n in enumerate(quotas):
        rest -= int(n)
        left[i] = hypergeometric(draw, int(n), rest, need)
        need -= int(left[i])
    return split_tree(left, lo, mid, shards, total, seed, leaf) + split_tree(quotas - left, mid, hi, shards, total, seed, leaf)


def _runs(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(__source, shard, a, b): the shard takes the source's permuted draws a to b. One group of a level is one node's row per source that it has."""
    quotas = drawn.groupBy("__source").agg(F.count(F.lit(1)).alias("n"))
    total = int(quotas.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    nodes, size = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "__source", "n", F.lit(0).cast("long").alias("first")), shards

    def children(leaf: int):
        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__source")
            lo, hi, at = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), pdf["first"].to_numpy()
            out = []
            for a, b, own in split_tree(pdf["n"].to_numpy(), lo, hi, shards, total, seed, leaf):
                some = own > 0
                out.append(pd.DataFrame({"lo": a, "hi": b, "__source": pdf["__source"].to_numpy()[some], "n": own[some], "first": at[some]}))
                at = at + own
            return pd.concat(out)

        return split

    while size > 1:
        size = -(-size // WIDTH)
        nodes = nodes.groupBy("lo").applyInPandas(children(size), "lo int, hi int, __source string, n long, first long")
    return nodes.select("__source", F.col("lo").alias("shard"), F.col("first").alias("a"), (F.col("first") + F.col("n") - 1).alias("b"))


def _fill(placed: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, singles) of the partial passes, from the block on that does not fit as a whole.

    ranges: __source, __block, passes, low, cut, below: what has low <= __h <= cut and a size from 1 to ``below`` is taken. Documents are passed in the
    order of the permutation and taken as long as they fit; one that does not is passed over, and the next ones are held against what is left
    now. No document passed over would fit later, as what is left only shrinks; so in the end what is left is less than any document.
    singles: __source, __block, passes, __h: the smallest document left over, where taking it comes nearer to the target than leaving it.
    """
    none, kept = F.lit(-(1 << 63)), []
    ends = met.filter((F.col("left") > 0) & (F.col("left") < F.col("size"))).select("__source", F.col("turn").alias("at"), none.alias("after"), F.col("left").cast("long").alias("gap"))
    last = met.groupBy("__source").agg(F.max("turn").alias("last"))
    start = open_ = checkpointed(ends.join(last, "__source"))
    blocks = met.select("__source", "__block", "passes", "turn")
    reach, done = FILL_BLOCKS, []
    while not open_.isEmpty():  # every round shrinks what is left below a document that did not fit, or looks through more blocks
        near = blocks.join(open_, "__source").filter((F.col("turn") >= F.col("at")) & (F.col("turn") < F.col("at") + reach))
        docs = placed.select("__source", "__block", "__h", "__size").join(near, ["__source", "__block"])
        docs = docs.filter((F.col("__size") > 0) & (F.col("__size") <= F.col("gap")) & ((F.col("turn") > F.col("at")) | (F.col("__h") > F.col("after"))))
        docs = docs.groupBy("__source", "__block", "turn", "passes", "gap", "__h").agg(F.sum("__size").alias("s"))  # repeated rows go together
        per = docs.groupBy("__source", "turn").agg(F.sum("s").alias("s"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("__source").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        upto = Window.partitionBy("__source", "turn").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
        docs = docs.join(per.select("__source", "turn", before.alias("before")), ["__source", "turn"]).withColumn("fits", F.col("before") + F.sum("s").over(upto) <= F.col("gap"))
        taken = F.when(F.col("fits"), F.col("__h"))
        met_now = docs.groupBy("__source", "__block", "turn", "passes", "gap").agg(
            F.min(taken).alias("low"), F.max(taken).alias("cut"), F.sum(F.when(F.col("fits"), F.col("s"))).alias("took"), F.min(F.when(~F.col("fits"), F.col("__h"))).alias("stop")
        )
        met_now = checkpointed(met_now)
        kept.append(met_now.filter("cut is not null").select("__source", "__block", "passes", "low", "cut", F.col("gap").alias("below")))
        found = met_now.groupBy("__source").agg(F.coalesce(F.sum("took"), F.lit(0)).alias("took"), F.min(F.when(F.col("stop").isNotNull(), F.struct("turn", "stop"))).alias("stop"))
        state = open_.join(found, "__source", "left").select(
            "__source",
            F.coalesce("stop.turn", F.col("at") + reach).alias("at"),
            F.coalesce("stop.stop", none).alias("after"),
            (F.col("gap") - F.coalesce("took", F.lit(0))).alias("gap"),
            "last",
        )
        state = checkpointed(state)
        over = (F.col("gap") == 0) | (F.col("at") > F.col("last"))
        done.append(state.filter(over))
        open_, reach = checkpointed(state.filter(~over)), reach * FILL_GROWTH
    ranges = met.select("__source", "__block", "passes", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("below")).limit(0)
    for part in kept:
        ranges = ranges.unionByName(part)
    ranges = checkpointed(ranges)
    gaps = None
    for part in done:
        gaps = part if gaps is None else gaps.unionByName(part)
    if gaps is None:
        return ranges, blocks.withColumn("__h", none).select("__source", "__block", "passes", "__h").limit(0)
    # what the partial pass has not taken: of each source with something left, the least
    mine = ranges.groupBy("__source", "__block").agg(F.collect_list(F.struct("low", "cut", "below")).alias("ranges"))  # one a round at most
    rest = blocks.join(gaps.filter("gap > 0").select("__source", "gap"), "__source").join(start.select("__source", F.col("at").alias("end")), "__source").filter(F.col("turn") >= F.col("end"))
    rest = placed.select("__source", "__block", "__h", "__size").join(rest, ["__source", "__block"]).join(mine, ["__source", "__block"], "left")
    taken = F.coalesce(F.exists("ranges", lambda r: F.col("__h").between(r["low"], r["cut"]) & (F.col("__size") <= r["below"])), F.lit(False))
    spare = rest.filter((F.col("__size") > 0) & ~taken).groupBy("__source", "__block", "passes", "gap", "__h").agg(F.sum("__size").alias("s")).filter(F.col("s") < 2 * F.col("gap"))
    return ranges, checkpointed(spare.groupBy("__source").agg(F.min(F.struct("s", "__h", "__block", "passes")).alias("p")).select("__source", "p.__block", "p.passes", "p.__h"))


def mixing_plan(placed: DataFrame, shards: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, draws). ``placed`` has __source, __size, __h, __block and is cheap to read again.

    sources: __source, source_size, weight, target. draws: __source, __block, pass, shard, low, cut, below: the documents of the block go to
    the shard once, where ``cut`` is given only those with low <= __h <= cut and a size of ``below`` at most.
    """
    by_block = checkpointed(placed.groupBy("__source", "__block").agg(F.sum("__size").alias("size")))
    sources = checkpointed(targets(by_block, weights, most))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    met = by_block.join(sources, "__source").withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    turn = F.xxhash64(F.lit(seed + 2), "__block")
    met = along(along(met, turn, ("__block",), F.col("size"), "before"), turn, ("__block",), F.lit(1).cast("long"), "turn")
    met = checkpointed(met.select("__source", "__block", "size", "passes", (F.col("rest") - F.col("before")).alias("left"), "turn"))

    ranges, single = _fill(placed, met)
    none = F.lit(None).cast("long")
    whole, part = met.filter("passes > 0"), met.filter("left > 0 and size > 0")
    all_of = (none.alias("low"), none.alias("cut"), none.alias("below"))
    drawn = whole.select("__source", "__block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"), *all_of)
    last = part.filter("left >= size").select("__source", "__block", (F.col("passes") + 1).alias("pass"), *all_of)
    split = ranges.select("__source", "__block", (F.col("passes") + 1).alias("pass"), "low", "cut", "below")
    alone = single.select("__source", "__block", (F.col("passes") + 1).alias("pass"), F.col("__h").alias("low"), F.col("__h").alias("cut"), F.lit((1 << 63) - 1).alias("below"))
    drawn = drawn.unionByName(last).unionByName(split).unionByName(alone)
    ties = ("__block", "pass", "cut")
    drawn = checkpointed(along(drawn, F.xxhash64(F.lit(seed + 3), *ties), ties, F.lit(1).cast("long"), "place"))

    runs = _runs(drawn, shards, seed).select("__source", "shard", F.explode(F.sequence("a", "b")).alias("place"))
    draws = checkpointed(drawn.join(runs, ["__source", "place"]).select("__source", "__block", "pass", "shard", "low", "cut", "below"))
    return sources, draws


def mixed_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words that the mix takes of it, repeats counted), copies, shards.

    ``shards`` are the leaves of the tree that take the document, as ``shard:pass`` in order, one for each copy. Null and wordless texts have size 0.
    An empty table gives no rows; a table without a word takes nothing. Sources that tie in cap per weight are filled in their order; repeated rows
    share their place and their fate. Texts of any length are counted whole. Other columns are ignored, whatever their names.
    """
    own = docs.select(column(id_col).alias("__id"), column(text_col).alias("__text"), column(source_col).alias("__of"))
    places = with_places(own, "__id", "__text", "__of")
    placed = checkpointed(places.select("__id", "__source", "__size", "__h"))
    blocks, shards = scale(placed)
    placed = placed.withColumn("__block", block_of(blocks))
    sources, draws = mixing_plan(placed, shards, **options)
    # a block is drawn once a pass and once a round of the fill
    taken = draws.groupBy("__source", "__block").agg(F.array_sort(F.collect_list(F.struct("shard", "pass", "low", "cut", "below"))).alias("draws"))
    mine = F.filter("draws", lambda r: r["cut"].isNull() | F.col("__h").between(r["low"], r["cut"]) & (F.col("__size") > 0) & (F.col("__size") <= r["below"]))
    met = placed.join(taken, ["__source", "__block"], "left").join(sources, "__source").withColumn("mine", mine)
    copies = F.coalesce(F.size("mine"), F.lit(0)).cast("long")
    shown = F.array_join(F.transform("mine", lambda r: F.concat_ws(":", r["shard"], r["pass"])), ",")
    return met.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * copies).alias("taken"), copies.alias("copies"), F.coalesce(shown, F.lit("")).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: all columns of ``docs``, a row for each time a document is taken, with shard and pass; each shard is one partition's
    run of rows in its own random order. Columns of ``docs`` named shard or pass are replaced, others may have any name."""
    rest = docs.drop("shard", "pass")
    own = packed(rest).select("own", *(F.col("own").getField(c).alias(n) for c, n in ((id_col, "__id"), (text_col, "__text"), (source_col, "__of"))))
    places = with_places(own, "__id", "__text", "__of").select("own", "__source", "__size", "__h")
    placed = checkpointed(places.drop("own"))
    blocks, shards = scale(placed)
    _, draws = mixing_plan(placed.withColumn("__block", block_of(blocks)), shards, **options)
    met = places.withColumn("__block", block_of(blocks)).join(draws, ["__source", "__block"]).filter(F.col("cut").isNull() | F.col("__h").between(F.col("low"), F.col("cut")) & (F.col("__size") > 0) & (F.col("__size") <= F.col("below")))
    shuffled = met.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(options.get("seed", SEED) + 4), "shard", "pass", "__h"))
    return shuffled.select(*unpacked(rest, {}), "shard", "pass")
