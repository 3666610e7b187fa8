"""Duplicate detection in five stages, each on what the earlier ones left: ISBN, title and author, title, content, fuzzy.

Inside a bucket books of equal title, author and ISBN (ISBNs of one book only count as one) are one node, and nodes are paired and scored, not books (see quotient.py). Candidates of
the fuzzy stage come from blocks of titles (see candidates.py). Order-dependent greedy passes are sorted sweeps (see cluster.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from . import candidates, quotient, verify
from .cluster import accepted, cut, spread, stars


@dataclass(frozen=True)
class MatchConfig:
    simhash_threshold: float = 0.80
    min_duplicate_size: int = 2
    #: Stage 5 can be left out without touching the others.
    enable_fuzzy: bool = True


BOOK = ["ord", *quotient.OWN, "simhash", "file_size", "file_format"]
#: What detection needs of books with fingerprints.
NEEDED = [*BOOK, "title_author_key", "title_key"]
#: Match types of the stages in order, with the prefixes of their group ids.
STAGES = {
    "isbn_exact": "group_isbn_",
    "title_author_simhash": "group_title_",
    "title_with_author_check": "group_titleonly_",
    "simhash_content": "group_simhash_",
    "fuzzy_match": "group_fuzzy_",
}


def isbn_groups(books: DataFrame, least: int = 2) -> DataFrame:
    """(bucket, ord) of books that share a normalised ISBN with enough others."""
    own = books.filter(F.col("isbn_normalized") != "").select(F.col("isbn_normalized").alias("bucket"), "ord")
    large = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("bucket")
    return own.join(large, "bucket", "left_semi")


def _large(members: DataFrame, least: int) -> DataFrame:
    some = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select("bucket")
    return members.join(some, "bucket", "left_semi")


def _keyed(books: DataFrame, key: Column, present: Column) -> DataFrame:
    return books.filter(present).select(key.cast("string").alias("bucket"), "ord", "node")


def _scored(books: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of the nodes of each bucket with author and title scores in both orders."""
    own = books.join(members.select("ord").distinct(), "ord", "left_semi")
    return cut(quotient.backward(quotient.forward(spread(quotient.node_pairs(quotient.bucket_nodes(members), quotient.nodes_of(own))))))


def group_similarity(books: DataFrame, members: DataFrame) -> DataFrame:
    """(bucket, similarity): mean overall similarity over all pairs of each bucket's members (bucket, ord)."""
    books = cut(quotient.noded(books).join(members.select("ord").distinct(), "ord", "left_semi"))
    own = cut(members.select("bucket", "ord").join(books.select("ord", "node"), "ord"))
    return quotient.mean_similarity(_scored(books, own), own, books)


def _similar(scored: DataFrame, members: DataFrame, books: DataFrame, config: MatchConfig, least: int, use_content: bool, need_author: bool, same_content: bool = False) -> DataFrame:
    """What the similarity pass leaves of each bucket, if enough."""
    arcs, edges = quotient.similar(scored, members, books, config.simhash_threshold * 0.8, use_content, need_author, same_content)
    edges = cut(edges)
    return cut(_large(accepted(members, arcs, None if edges.isEmpty() else edges), least))


def _by_titles(left: DataFrame, config: MatchConfig, key: str, need_author: bool) -> tuple[DataFrame, DataFrame]:
    """(members, similarities) of books with an equal title key: verifier, then similarity. Titles are scored where the verifier can match the authors, and between
    books that it has accepted; most books of an equal title have authors that settle it."""
    least = config.min_duplicate_size
    members = cut(_large(_keyed(left, F.col(key), F.col(key) != ""), least))
    own = left.join(members.select("ord").distinct(), "ord", "left_semi")
    pairs = cut(quotient.authors_scored(spread(quotient.node_pairs(quotient.bucket_nodes(members), quotient.nodes_of(own)))))
    pairs = cut(verify.may_match(pairs))
    scored = cut(quotient.titles_scored(spread(pairs.filter("may_match").drop("may_match"))))
    found = cut(_large(accepted(members, quotient.verified_arcs(scored)), least))
    kept = found.select("bucket", "node").distinct()
    others = pairs.filter("not may_match").drop("may_match")
    for s in "ab":
        others = others.join(kept.withColumnRenamed("node", f"{s}_node"), ["bucket", f"{s}_node"], "left_semi")
    scored = scored.unionByName(cut(quotient.titles_scored(spread(others))))
    found = _similar(scored, found, left, config, least, True, need_author)
    return found, quotient.mean_similarity(scored, found, left)


def _by_content(left: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(members, similarities) of books with equal content hashes: the mean counts before the similarity pass. Titles are scored only where names leave it open."""
    least = config.min_duplicate_size
    members = cut(_large(_keyed(left, F.col("simhash"), F.col("simhash") != 0), least))
    own = left.join(members.select("ord").distinct(), "ord", "left_semi")
    members = cut(members.join(quotient.may_reach(members, own, config.simhash_threshold), "bucket", "left_semi"))
    own = left.join(members.select("ord").distinct(), "ord", "left_semi")
    pairs = quotient.forward(spread(quotient.node_pairs(quotient.bucket_nodes(members), quotient.nodes_of(own))))
    pairs = cut(pairs)
    # the other order matters to the mean only where books of two nodes alternate
    turned = F.col("a_last") > F.col("b_first")
    none = F.lit(None).cast("double")
    both = quotient.backward(pairs.filter(turned)).unionByName(pairs.filter(~turned).withColumns({"author_ba": none, "title_ba": none}))
    similar = cut(quotient.mean_similarity(both, members, left).filter(F.col("similarity") >= config.simhash_threshold))
    members = cut(members.join(similar, "bucket", "left_semi"))
    scored = cut(quotient.backward(pairs.join(similar.select("bucket"), "bucket", "left_semi")))
    return _similar(scored, members, left, config, least, False, True, True), similar


def near_books(left: DataFrame, config: MatchConfig, fresh: DataFrame | None = None) -> DataFrame:
    """(j, i): the earlier book of a pair, as a seed, takes the later one; of all pairs, or of those with a book of ``fresh`` (ord)."""
    pairs = cut(candidates.fuzzy_pairs(left, config.min_duplicate_size > 2, fresh))
    for s in "ab":
        pairs = pairs.join(left.select(*(F.col(x).alias(f"{s}_{x}") for x in BOOK)), f"{s}_ord")
    pairs = spread(pairs).withColumn("title_ab", similarity.title_from_040(F.col("a_title"), F.col("b_title"))).filter("title_ab >= 0.40")
    near = cut(pairs.select(*pairs.columns, similarity.pair_overall("a_", "b_", F.col("author_ab"), F.col("title_ab")).alias("overall"))).filter("overall >= 0.55")
    near = cut(verify.verified(near).select("a_ord", "b_ord", F.col("verdict.is_same_book").alias("same"))).filter("same")
    return near.select(F.col("a_ord").alias("j"), F.col("b_ord").alias("i")).distinct()


def cover_groups(left: DataFrame, near: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(members, similarities): a greedy star cover along ``near``, then the similarity pass inside each star."""
    least = config.min_duplicate_size
    cover = cut(_large(stars(near).select(F.col("seed").cast("string").alias("bucket"), "ord"), least).join(left.select("ord", "node"), "ord"))
    scored = _scored(left, cover)
    found = _similar(scored, cover, left, config, least, True, True)
    return found, quotient.mean_similarity(scored, found, left)


def run_stage(kind: str, left: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(members (bucket, ord), similarities (bucket, similarity)) of one stage over the books that it is given."""
    if kind == "isbn_exact":
        members = isbn_groups(left, config.min_duplicate_size)
        similar = members.select("bucket").distinct().withColumn("similarity", F.lit(1.0))
    elif kind == "title_author_simhash":
        members, similar = _by_titles(left, config, "title_author_key", False)
    elif kind == "title_with_author_check":
        members, similar = _by_titles(left, config, "title_key", True)
    elif kind == "simhash_content":
        members, similar = _by_content(left, config)
    else:
        members, similar = cover_groups(left, near_books(left, config), config)
    return settled(kind, members, similar)


def settled(kind: str, members: DataFrame, similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a stage keeps: groups that are similar enough, with their members."""
    if kind in ("title_with_author_check", "fuzzy_match"):
        similar = similar.filter("similarity >= 0.70")
    similar = cut(similar)
    members = cut(members.select("bucket", "ord").join(similar, "bucket", "left_semi"))
    return members, similar.join(members, "bucket", "left_semi")


def prepared(books: DataFrame) -> DataFrame:
    """What the stages need of books with fingerprints."""
    return quotient.noded(cut(books.select(*NEEDED)))


def detect(books: DataFrame, config: MatchConfig = MatchConfig(), upto: str = "fuzzy_match") -> tuple[DataFrame, DataFrame]:
    """(groups, members) of a catalogue with fingerprints, by the stages as far as ``upto`` (a match type).

    groups: group_id, match_type, similarity, n_books. members: group_id, match_type, ord, member_pos. ``ord`` is the catalogue's order, unique.
    """
    return collected([(kind, members, similar) for kind, members, similar in stages(books, config, upto)])


def collected(done: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the stages' results, numbered on over the stages."""
    members = groups = None
    for stage, (kind, own, similar) in enumerate(done):
        prefix = STAGES[kind]
        m = own.select(F.lit(stage).alias("stage"), F.lit(prefix).alias("prefix"), F.lit(kind).alias("match_type"), "bucket", "ord")
        g = own.groupBy("bucket").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n_books")).join(similar, "bucket")
        g = g.select(F.lit(stage).alias("stage"), F.lit(prefix).alias("prefix"), F.lit(kind).alias("match_type"), "bucket", "first", "n_books", "similarity")
        members, groups = (m, g) if members is None else (members.unionByName(m), groups.unionByName(g))
    groups = numbered(groups)
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("ord")) - 1
    members = members.join(groups.select("stage", "bucket", "group_id"), ["stage", "bucket"]).select("group_id", "match_type", "ord", place.alias("member_pos"))
    return groups.select("group_id", "match_type", "similarity", "n_books"), members


def stages(books: DataFrame, config: MatchConfig = MatchConfig(), upto: str = "fuzzy_match") -> Iterator[tuple[str, DataFrame, DataFrame]]:
    """(match type, members (bucket, ord), similarities (bucket, similarity)) of each stage in order; each works on what the earlier ones left."""
    left = cut(prepared(books))
    kinds = [k for k in STAGES if config.enable_fuzzy or k != "fuzzy_match"]
    for kind in kinds[: kinds.index(upto) + 1 if upto in kinds else None]:
        members, similar = run_stage(kind, left, config)
        yield kind, members, similar
        left = cut(left.join(members, "ord", "left_anti"))


def numbered(groups: DataFrame) -> DataFrame:
    """Group ids count on over the stages, in order of the groups' first books. Counts per stage and block first, so that no task sees all groups."""
    block = F.floor(F.col("first") / 100_000)
    own = groups.withColumn("block", block)
    per = own.groupBy("stage", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stage", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select("stage", "block", before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("stage", "block").orderBy("first")) - 1
    number = (F.col("base") + F.col("inside")).cast("string")
    return cut(own.withColumn("inside", inside).join(base, ["stage", "block"]).withColumn("group_id", F.concat("prefix", number)).drop("block", "base", "inside"))


def statistics(books: DataFrame, members: DataFrame) -> DataFrame:
    """One row: groups, members, removable, bytes, bytes saved if the largest stays, and counts per format and match type as maps."""
    own = members.join(books.select("ord", "file_size", "file_format"), "ord")
    per = own.groupBy("group_id", "match_type").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("size"), F.max("file_size").alias("largest"))
    sums = per.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_books"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum(F.col("size") - F.col("largest")), F.lit(0)).alias("saved_size"),
    )

    def counts(df: DataFrame, key: str, name: str) -> DataFrame:
        made = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return made.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    return sums.crossJoin(counts(own, "file_format", "format_counts")).crossJoin(counts(per, "match_type", "match_type_counts"))  # one row each
