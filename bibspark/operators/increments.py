"""Detection of a growing catalogue: new books recompute only the buckets that they touch, stage by stage.

A stage's result in a bucket depends on the bucket's books alone. So a stage keeps its groups in all buckets but those of books that have come to
it or gone from it, runs over the books of these buckets, and hands on which books have now come to the next stage or gone from it. The
fuzzy stage keeps which book takes which; only pairs with a new book are sought, and stars are covered anew in the connected parts
that have changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detect
from .cluster import components, cut
from .detect import MatchConfig

#: Bucket of a book in each stage that has buckets; empty ones are none.
KEYS = {
    "isbn_exact": "isbn_normalized",
    "title_author_simhash": "title_author_key",
    "title_with_author_check": "title_key",
    "simhash_content": "simhash",
}


@dataclass(frozen=True)
class State:
    """Books, each stage's (members, similarities), and which book takes which in the fuzzy stage (j, i). All are checkpointed tables."""

    books: DataFrame
    stages: dict[str, tuple[DataFrame, DataFrame]]
    near: DataFrame

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(groups, members) as detect() gives them."""
        return detect.collected([(kind, *found) for kind, found in self.stages.items()])


def begun(books: DataFrame, config: MatchConfig = MatchConfig()) -> State:
    """A full run over books with fingerprints."""
    left = own = cut(detect.prepared(books))
    stages = {}
    for kind in KEYS:
        stages[kind] = tuple(map(cut, detect.run_stage(kind, left, config)))
        left = cut(left.join(stages[kind][0], "ord", "left_anti"))
    near = cut(detect.near_books(left, config))
    stages["fuzzy_match"] = tuple(map(cut, detect.settled("fuzzy_match", *detect.cover_groups(left, near, config))))
    return State(own, stages, near)


def _bucket(kind: str) -> Column:
    key = F.col(KEYS[kind])
    return F.when(key != (0 if kind == "simhash_content" else ""), key.cast("string"))


def extended(state: State, fresh: DataFrame, config: MatchConfig = MatchConfig()) -> State:
    """The state with books added; equal to a full run over all of them. ``fresh`` has fingerprints and places (ord) that no book has yet."""
    books = cut(detect.prepared(state.books.unionByName(fresh, allowMissingColumns=True)))  # an ISBN may have become another book's too
    left = books
    changed = cut(fresh.select("ord", F.lit(False).alias("was"), F.lit(True).alias("now")))  # books that are at a stage in one run only
    stages = {}
    for kind in KEYS:
        members, similar = state.stages[kind]
        dirty = cut(books.withColumn("bucket", _bucket(kind)).join(changed, "ord", "left_semi").filter("bucket is not null").select("bucket").distinct())
        touched = cut(left.withColumn("bucket", _bucket(kind)).join(dirty, "bucket", "left_semi").drop("bucket"))
        new_members, new_similar = detect.run_stage(kind, touched, config)
        new_members, old = cut(new_members), cut(members.join(dirty, "bucket", "left_semi"))
        stages[kind] = (cut(members.join(dirty, "bucket", "left_anti").unionByName(new_members)), cut(similar.join(dirty, "bucket", "left_anti").unionByName(new_similar)))
        # who has come to the next stage, or gone from it
        seen = changed.unionByName(touched.join(changed, "ord", "left_anti").select("ord", F.lit(True).alias("was"), F.lit(True).alias("now")))
        flag = lambda df, name: df.select("ord", F.lit(True).alias(name))
        seen = seen.join(flag(old, "had"), "ord", "left").join(flag(new_members, "has"), "ord", "left")
        seen = seen.select("ord", (F.col("was") & F.col("had").isNull()).alias("was"), (F.col("now") & F.col("has").isNull()).alias("now"))
        changed = cut(seen.filter(F.col("was") != F.col("now")))
        left = cut(left.join(stages[kind][0], "ord", "left_anti"))

    come, gone = changed.filter("now").select("ord"), changed.filter("was").select("ord")
    end = lambda df, name: df.select(F.col("ord").alias(name))
    stay = state.near.join(end(gone, "j"), "j", "left_anti").join(end(gone, "i"), "i", "left_anti")
    near = cut(stay.select("j", "i").unionByName(detect.near_books(left, config, come)).distinct())
    lost = state.near.join(end(gone, "j"), "j", "left_semi").select(F.col("i").alias("ord")).unionByName(state.near.join(end(gone, "i"), "i", "left_semi").select(F.col("j").alias("ord")))
    touched = cut(changed.select("ord").unionByName(lost).distinct())
    parts = cut(components(near.select(F.col("j").alias("a"), F.col("i").alias("b"))))
    hit = parts.join(touched.withColumnRenamed("ord", "node"), "node", "left_semi").select("component").distinct()
    nodes = cut(parts.join(hit, "component", "left_semi").select(F.col("node").alias("ord")).unionByName(touched).distinct())
    own = cut(near.join(end(nodes, "j"), "j", "left_semi").select("j", "i"))
    new_members, new_similar = detect.settled("fuzzy_match", *detect.cover_groups(left, own, config))
    members, similar = state.stages["fuzzy_match"]
    over = cut(members.join(nodes, "ord", "left_semi").select("bucket").distinct())
    stages["fuzzy_match"] = (cut(members.join(over, "bucket", "left_anti").unionByName(new_members)), cut(similar.join(over, "bucket", "left_anti").unionByName(new_similar)))
    return State(books, stages, near)
